"""Readers, writers and test-data adaptors."""
