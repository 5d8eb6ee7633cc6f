"""Queries over the provided tables, one or more per operator."""

from __future__ import annotations

import importlib

_MODULES = [
    "evaluation",
    "reporting",
    "documents",
    "bids",
    "search",
]


def load():
    """Import every query module and return the registry."""
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")
