"""Readers, parsers and writers for the canonical tables."""
