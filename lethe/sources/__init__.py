"""Readers, parsers, fixtures and the table store."""
