"""Readers, writers and the archive manifest."""
