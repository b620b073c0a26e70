"""Named queries over the test tables, each with its SQL check where one exists."""

from __future__ import annotations

from cadastrum.registry.base import ORACLES, QUERIES
from cadastrum.registry import explorer, income, publishing, sales, scalars  # noqa: F401  (they register themselves)

__all__ = ["ORACLES", "QUERIES"]
