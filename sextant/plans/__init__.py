"""Sextant plans."""
