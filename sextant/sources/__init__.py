"""Sextant sources."""
