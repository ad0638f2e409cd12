"""Scalar operators on columns, all inside the JVM."""
