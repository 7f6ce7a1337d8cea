"""Query catalogue: importing the q_* modules registers every query."""

from __future__ import annotations

import importlib
import pkgutil


def all_queries():
    """Queries and their SQL twins, by name."""
    from tidepanel.plans import catalog

    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"{__name__}.{mod}")
    return catalog.QUERIES, catalog.ORACLES
