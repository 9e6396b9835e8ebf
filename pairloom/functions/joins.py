"""Joins with a side that is expected to be small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.session import cut_lineage

SMALL_ROWS = 100_000


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def join_small(large: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner",
               rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast the small side only after counting it; beyond the bound Spark's own (skew-split) join is used.

    The small side is written down first, so that it is computed once and the count reads the written rows.
    """
    small = cut_lineage(small)
    return large.join(F.broadcast(small) if is_small(small, rows) else small, list(keys), how)
