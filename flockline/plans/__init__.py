"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from pyspark.sql import functions as F

_MODULES = ["text", "vectors", "clusters", "quality", "windows", "alerts", "reports", "state", "streams"]


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for name in _MODULES:
        merged.update(getattr(import_module(f"flockline.plans.{name}"), attribute))
    return merged


def _wide(query):
    """Whole numbers leave a query as bigint, the type their SQL counterparts have."""

    @wraps(query)
    def run(spark, path):
        df = query(spark, path)
        return df.select(
            *[F.col(c).cast("bigint").alias(c) if kind in ("int", "smallint") else F.col(c) for c, kind in df.dtypes]
        )

    return run


def all_queries() -> dict:
    return {name: _wide(query) for name, query in _collect("QUERIES").items()}


def all_oracles() -> dict:
    return _collect("ORACLES")
