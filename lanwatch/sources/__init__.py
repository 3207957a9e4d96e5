"""Readers, line parsers and writers."""
