"""Readers, writers and cached datasets."""
