"""Derived views on the given tables and the catalogue of queries."""
