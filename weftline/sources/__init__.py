"""Readers: explicit schemas and table access."""
