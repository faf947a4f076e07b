"""Example views over the driver tables and the registered queries with their SQL oracles."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every query module; returns (queries, oracles)."""
    from platewright.plans import registry

    for m in pkgutil.iter_modules(__path__):
        if m.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{m.name}")
    return registry.QUERIES, registry.ORACLES
