"""Registered queries: the operators bound to the given tables, each with its SQL twin."""

from __future__ import annotations

from . import (  # noqa: F401  (importing a module registers its queries)
    grouped,
    joined,
    learned,
    projected,
    recipes,
    scanned,
    shaped,
    spatial,
    vectors,
    windowed,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
