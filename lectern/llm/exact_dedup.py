"""Exact duplicates by sorting contents (native)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import numbered, row_number, shuffle_partitions, text_or_empty, without_rows, written

BLANKS = " \t\n\x0b\f\r"
# A group of copies is split when it would fill more than a quarter of a mean partition.
SHARE = 4


def normalised(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), BLANKS, text)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, row``.

    Texts are range-partitioned by splitters that Spark samples from the leading bytes and a
    fingerprint of the normalised text (so the sample stays small however long texts are, and
    texts with a common beginning still spread), sorted externally within each partition, and
    neighbours are compared in full: the window's partition key is the normalised text itself.
    Of equal texts the row with the most code points stays, then the smallest id.

    A group of copies larger than a part of a partition is first cut into slices by row number.
    Such groups are found by counting fingerprints (at most ``SHARE * parts`` can be that large,
    so this list has a fixed bound), each slice is sorted like a group of its own, and only the
    slices' best rows, at most ``2 * SHARE * parts``, are compared again.

    Null text counts as empty. Of rows with the same id, length and text the first in table
    order stays; a null id comes after all others. ``row`` is the row's number in the table.
    Empty tables give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = parts or shuffle_partitions(spark)
    total = max(1, docs.count())
    texts = (
        docs.select(
            F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"), row_number(docs).alias("row")
        )
        .select("doc_id", "row", F.length("t").alias("chars"), normalised(F.col("t")).alias("norm"))
        .withColumn("print", F.xxhash64("norm"))
    )
    hot = (
        texts.groupBy("print")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") * SHARE * parts > total)
        .select("print", F.ceil(F.col("copies") * SHARE * parts / total).alias("slices"))
    )
    salted = texts.join(F.broadcast(hot), "print", "left").select(
        "doc_id",
        "row",
        "chars",
        "norm",
        "print",
        F.substring("norm", 1, 8).alias("head"),
        F.col("slices").isNotNull().alias("hot"),
        F.coalesce(F.pmod(F.xxhash64("row"), "slices"), F.lit(0)).alias("slice"),
    )
    same = Window.partitionBy("head", "print", "slice", "norm")
    best_first = (F.desc("chars"), F.asc_nulls_last("doc_id"), F.asc("row"))
    ordered = same.orderBy(*best_first)
    local = written(
        salted.repartitionByRange(parts, "head", "print", "slice")
        .select(
            "*",
            F.row_number().over(ordered).alias("rank"),
            F.first("doc_id").over(ordered).alias("best_id"),
            F.first("row").over(ordered).alias("best_row"),
            F.count(F.lit(1)).over(same).alias("size"),
        )
        .select(
            "doc_id",
            "row",
            "chars",
            "best_id",
            "best_row",
            "size",
            F.sha2("norm", 256).alias("text_sha256"),
            F.when(F.col("hot") & (F.col("rank") == 1), F.col("norm")).alias("again"),
        ),
        "exact-sorted",
    )
    whole = Window.partitionBy("again")
    merged = local.filter(F.col("again").isNotNull()).select(
        F.col("row").alias("slice_row"),
        F.first("doc_id").over(whole.orderBy(*best_first)).alias("all_id"),
        F.first("row").over(whole.orderBy(*best_first)).alias("all_row"),
        F.sum("size").over(whole).alias("all_size"),
    )
    return local.join(F.broadcast(merged), F.col("best_row") == F.col("slice_row"), "left").select(
        "doc_id",
        F.when(F.col("slice_row").isNull(), F.col("best_id")).otherwise(F.col("all_id")).alias("keep_id"),
        F.coalesce("all_size", "size").cast("long").alias("group_size"),
        (F.col("row") == F.coalesce("all_row", "best_row")).alias("kept"),
        "text_sha256",
        "row",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; an empty table stays empty."""
    docs = numbered(docs)
    found = exact_duplicates(docs, id_col, text_col)
    return without_rows(docs, written(found.filter(~F.col("kept")).select("row"), "exact-dropped"))
