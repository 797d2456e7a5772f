"""All registered queries."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> dict:
    """Import every query module and return the catalog by name."""
    from docrisk.catalog.core import CATALOG

    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    return CATALOG
