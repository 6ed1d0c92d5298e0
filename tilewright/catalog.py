"""All registered queries by name."""

from __future__ import annotations

from tilewright.plans import agreement, files, kernels, rasters, screening, spatial, texts
from tilewright.plans.registry import QUERIES, SQL

__all__ = ["agreement", "files", "kernels", "oracle_sql", "queries", "rasters", "screening", "spatial", "texts"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
