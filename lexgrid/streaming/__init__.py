"""Incremental index building."""
