"""Readers and parsers of outside data."""
