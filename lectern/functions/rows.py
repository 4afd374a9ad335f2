"""Arrays to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, kept: Sequence[str | Column], items: Column, item: str, index: str | None = None) -> DataFrame:
    """One row per element of ``items``: the kept columns, ``item`` and, if named, ``index``.

    An inner explode makes the optimizer test the array for emptiness below the projections
    that build it, which computes costly arrays a second time. The outer form followed by a
    test of the index gives the same rows and computes them once.
    """
    at = index or "_at"
    rows = df.select(*kept, F.posexplode_outer(items).alias(at, item)).filter(F.col(at).isNotNull())
    return rows if index else rows.drop(at)
