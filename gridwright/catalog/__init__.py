"""Registered queries with their checking SQL."""

from gridwright.catalog import (  # noqa: F401
    averaging,
    cells,
    gaps,
    moments,
    plans,
    sources,
    splitjoin,
)
from gridwright.catalog.base import REGISTRY

__all__ = ["REGISTRY"]
