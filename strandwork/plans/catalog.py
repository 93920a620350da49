"""All queries over the reference tables; importing this module registers them."""

from __future__ import annotations

from . import graphs, measures, networks, relational, storage, texts, timeseries  # noqa: F401
from .base import REGISTRY

__all__ = ["REGISTRY"]
