"""Quotation analytics on Spark: find quotations of a pinned corpus in free text and verify each of them."""
