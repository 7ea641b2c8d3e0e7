"""Column names that a table does not have yet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as it takes to clash with no column of ``df``."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name
