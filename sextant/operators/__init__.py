"""Sextant operators."""
