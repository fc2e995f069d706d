"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

import importlib

MODULES = ["html_extract", "secrets", "personal_data", "substring_dedup", "exact_dedup", "toxicity", "near_dedup", "pieces", "pseudo_likelihood", "decontaminate", "filter_audit", "centroids", "curves"]


def _gather(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{module}"), name)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
