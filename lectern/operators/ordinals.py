"""Running numbers and top rows per group that hold up when one group is very large."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import scratch_path
from lectern.sources.store import stored


def running_number(
    df: DataFrame, partition: Sequence[str], order: Sequence[str], name: str, slices: int | None = None
) -> DataFrame:
    """1-based position of each row in its group, for groups of any size and order columns of any type.

    ``partition`` and ``order`` together must tell rows apart. Spark range-partitions the table by
    them, so a group that holds most of the rows lies in many neighbouring slices; rows are numbered
    within (group, slice), and a slice starts behind the rows that its group has in the slices before.
    The numbered slices are written once to the shared folder: counts and rows then agree on where
    the slices were cut, also when a task runs again.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(slices, *partition, *order).withColumn("_slice", F.spark_partition_id())
    keys = [*partition, "_slice"]
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    numbered = stored(cut.withColumn("_inside", inside), scratch_path(df.sparkSession, "numbered"))
    counts = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per slice and group.
    before = Window.partitionBy(*(partition or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys], F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys])
    return (
        numbered.join(offsets, on)
        .withColumn(name, (F.col("_offset") + F.col("_inside")).cast("long"))
        .select(*df.columns, name)
    )


# Spark prunes ranks before the shuffle up to this limit (spark.sql.optimizer.windowGroupLimitThreshold).
PRUNED_RANK = 1_000


def top_rows(df: DataFrame, partition: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows per group, numbered from 1.

    The rank filter is pruned before the shuffle (at most ``k`` rows per group leave a task), so a
    large group never meets in one task. Beyond ``PRUNED_RANK`` Spark does not prune; then rows are
    ranked in slices of each group first, and only the slices' best meet.
    """
    def ranked(rows: DataFrame, by: Sequence) -> DataFrame:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)

    if k > PRUNED_RANK:
        slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        number = F.pmod(F.monotonically_increasing_id(), F.lit(slices))
        df = ranked(df.withColumn("_slice", number), [*partition, "_slice"]).drop("_slice", name)
    return ranked(df, partition)
