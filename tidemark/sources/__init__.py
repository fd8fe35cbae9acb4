"""Readers, writers and text or binary forms of points and series."""
