"""Bindings to the shared tables and the catalog of registered queries with their oracle SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["catalog_core", "catalog_clean", "catalog_text", "catalog_dups", "catalog_review"]


def load_catalog():
    for name in _MODULES:
        import_module(f"caselight.plans.{name}")
    from caselight.plans.registry import CATALOG

    return CATALOG
