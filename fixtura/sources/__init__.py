"""Readers of landed files, with explicit schemas."""
