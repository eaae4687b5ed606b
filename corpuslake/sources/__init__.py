"""Readers and writers; every schema is stated, none is inferred."""
