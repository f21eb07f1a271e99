"""Registered queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil


def load_plans():
    """Import every query module of this package and return the filled registry."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    from .registry import PLANS

    return PLANS
