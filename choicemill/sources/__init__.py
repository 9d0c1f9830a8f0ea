"""Readers, writers and written stages."""
