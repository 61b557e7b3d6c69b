"""Whole reports put together from operators, and the registered queries."""

from __future__ import annotations

import importlib

FAMILIES = ("profile_queries", "relation_queries", "analysis_queries", "search_queries", "model_queries", "report_queries")


def load_all():
    """Import every query family and return the registry."""
    for family in FAMILIES:
        importlib.import_module(f"facetwise.plans.{family}")
    return importlib.import_module("facetwise.plans.registry")
