"""Queries over the given tables, one module per area."""
from __future__ import annotations

import importlib

AREAS = ["tagging", "controlled", "validation", "catalog_rows", "audits", "diffs", "learning", "media",
         "matching", "web", "monitoring", "registries", "storage"]


def load():
    """Import every area and return the registry."""
    for area in AREAS:
        importlib.import_module(f"tagloom.plans.{area}")
    return importlib.import_module("tagloom.plans.registry")
