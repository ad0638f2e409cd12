"""Readers and writers with fixed schemas and checks."""
