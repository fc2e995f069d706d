"""Sextant functions."""
