"""Readers, log normalisers, snapshot parsers and writers."""
