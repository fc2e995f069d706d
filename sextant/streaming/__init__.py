"""Sextant streaming."""
