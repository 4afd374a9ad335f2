"""Encoding, pooling, normalisation, section roll-ups and the embedding catalog."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import fixed
from lectern.functions import arrow, vectors
from lectern.functions import text as X
from lectern.functions.rows import each
from lectern.operators import filters, ordinals
from lectern.session import scratch_path
from lectern.sources.store import stored

DIM = 64
# Titles of a corpus that are sent to every task when parts are joined to their totals.
SENT_TITLES = 1 << 16
# Partial sums that a task holds while it pools vectors.
POOL_BYTES = 64 << 20


def embed(df: DataFrame, column: str = "text", dim: int = DIM, name: str = "embedding") -> DataFrame:
    """Default encoder: hashed token counts as a unit vector, deterministic and model-free."""
    encode = arrow.hashed_counts(dim)
    return df.withColumn(name, encode(X.whitespace_tokens(F.lower(F.col(column)))))


def embed_with(
    df: DataFrame,
    column: str,
    load: Callable[[], Callable[[list[str]], np.ndarray]],
    batch_size: int = fixed.ENCODER_BATCH,
    name: str = "embedding",
) -> DataFrame:
    """Encoder plug-in: ``load`` runs once per Python worker and returns texts -> matrix.

    Vectors are normalised to unit length. Texts travel in Arrow batches and are handed to
    the model ``batch_size`` at a time.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            values = texts.fillna("").tolist()
            parts = [
                np.asarray(model(values[i : i + batch_size]), dtype=np.float64)
                for i in range(0, len(values), batch_size)
            ]
            if not parts:
                yield pd.Series([], dtype=object)
                continue
            matrix = np.vstack(parts)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            unit = (matrix / np.maximum(norms, fixed.NORM_EPS)).astype(np.float32)
            yield pd.Series(list(unit))

    return df.withColumn(name, encode(F.col(column)))


def embed_by_length(
    df: DataFrame,
    column: str,
    load: Callable[[], Callable[[list[str]], np.ndarray]],
    batch_size: int = fixed.ENCODER_BATCH,
    name: str = "embedding",
    length: Column | None = None,
) -> DataFrame:
    """:func:`embed_with` on texts of like length: a model that pads each call to its longest text pads far less.

    Rows are sorted by ``length`` (white-space tokens unless given) inside their partitions, longest first, so nothing is
    shuffled, no length can gather in one task, and a call that is too large fails at once. Vectors do not change.
    """
    tokens = X.token_count(F.coalesce(F.col(column), F.lit(""))) if length is None else length
    ordered = df.withColumn("_length", tokens).sortWithinPartitions(F.desc("_length")).drop("_length")
    return embed_with(ordered, column, load, batch_size, name)


def embedding_text(df: DataFrame, format: str | None = None, name: str = "embedding_text") -> DataFrame:
    """Text to embed: table rows get their context in front; chunks and unified tables use their text."""
    row_text = F.concat(
        F.coalesce(_col(df, "context_paragraph"), F.lit("")), F.lit(" "), F.coalesce(_col(df, "text_fallback"), F.lit(""))
    )
    if format is None:
        value = F.when(F.col("table_format") == "standard", row_text).otherwise(_col(df, "text"))
    else:
        value = row_text if format == "standard" else _col(df, "text")
    return df.withColumn(name, value)


def _col(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def l2_normalize(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, vectors.l2_normalize(F.col(column)))


def cosine(df: DataFrame, a: str, b: str, name: str = "cosine") -> DataFrame:
    return df.withColumn(name, vectors.cosine(F.col(a), F.col(b)))


def mean_pool(df: DataFrame, key: str, column: str = "vector", mask: str | None = None) -> DataFrame:
    """Masked mean of the vectors of each key; the mask sum is at least 1e-9.

    Vectors are added up inside each task first: one partial vector per key and task is
    shuffled, not one row per dimension, so a key with most of the rows costs no more than
    any other.
    """
    weight = F.lit(1.0) if mask is None else F.coalesce(F.col(mask).cast("double"), F.lit(0.0))
    rows = df.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("v"), weight.alias("w"))
    key_type = df.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("key", key_type),
            T.StructField("v", T.ArrayType(T.DoubleType())),
            T.StructField("w", T.DoubleType()),
        ]
    )

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            if batch.empty:
                continue
            matrix = np.vstack(batch["v"].to_numpy()) * batch["w"].to_numpy()[:, None]
            codes, keys = pd.factorize(batch["key"], use_na_sentinel=False)
            totals = np.zeros((len(keys), matrix.shape[1]))
            np.add.at(totals, codes, matrix)
            weights = np.bincount(codes, weights=batch["w"].to_numpy(), minlength=len(keys))
            for k, total, w in zip(keys, totals, weights):
                if k in sums:
                    sums[k] = (sums[k][0] + total, sums[k][1] + w)
                else:
                    sums[k] = (total, w)
            if len(sums) * matrix.shape[1] * 8 > POOL_BYTES:  # many keys: hand on partial sums instead of holding them
                yield _frame(sums)
                sums = {}
        if sums:
            yield _frame(sums)

    added = rows.mapInPandas(partial, schema)
    # Per dimension from here on; each (key, dimension) meets at most one row per task.
    terms = each(added, ["key", "w"], F.col("v"), "x", "dim")
    summed = terms.groupBy("key", "dim").agg(F.sum("x").alias("x"), F.sum("w").alias("w"))
    pooled = summed.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("dim", (F.col("x") / F.greatest("w", F.lit(fixed.POOL_EPS))).alias("x")))).alias("v")
    )
    return pooled.select(F.col("key").alias(key), F.transform("v", lambda e: e["x"]).alias("pooled"))


def _frame(sums: dict) -> pd.DataFrame:
    return pd.DataFrame({"key": list(sums), "v": [s[0] for s in sums.values()], "w": [s[1] for s in sums.values()]})


def section_summaries(chunks: DataFrame, order: str = "chunk_index", by: str = "document") -> DataFrame:
    """Summaries joined per section title, with the chunk count and the first chunk's metadata.

    Sections belong to one document, so a group is as large as a document. With
    ``by="title"`` equal titles of all documents form one section: its counts and metadata
    are aggregated, and its text comes as one ``part`` per document, numbered in document order
    (``section_id``, ``part_order``), because a title shared by a third of the corpus fits no
    single value.
    """
    if by not in ("document", "title"):
        raise ValueError("by must be 'document' or 'title'")
    title = F.coalesce("section_title", F.lit("Unknown"))
    meta = [c for c in ("university_id", "program", "year") if c in chunks.columns]
    rows = chunks.select(title.alias("section_title"), "source_file", order, "summary", *meta)
    grouped = rows.groupBy("source_file", "section_title").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order, "summary"))), lambda e: e["summary"]), " "
        ).alias("text"),
        F.count(F.lit(1)).alias("num_chunks"),
        F.min(order).alias("first_index"),
        *[F.min_by(c, order).alias(c) for c in meta],
    )
    if by == "document":
        return grouped.withColumn(
            "section_id", F.concat_ws("_", F.col("source_file").cast("string"), F.lit("section"), "first_index")
        ).drop("first_index")
    # Read for counts, numbers and parts: the text work below is done once.
    grouped = stored(grouped.drop("first_index"), scratch_path(chunks.sparkSession, "sections"))
    totals = filters.joinable(
        grouped, "section_title", F.sum("num_chunks").alias("num_chunks"), *[F.min_by(c, "source_file").alias(c) for c in meta]
    )
    totals = totals.withColumn("section_id", F.sha2("section_title", 256))
    parts = grouped.select("section_title", F.col("source_file").alias("part"), "text")
    numbered = ordinals.running_number(parts, ["section_title"], ["part"], "part_order")
    # Titles are one row each on the right. Few are sent to every task; of many, the rows of a
    # title that most documents share are split by adaptive execution.
    held = totals.count()
    return numbered.join(F.broadcast(totals) if held <= SENT_TITLES else totals, "section_title")


def embedding_catalog(
    emb: DataFrame, model: str, key: str = "chunk_id", order: str | None = None, start: int = 0, column: str = "embedding"
) -> DataFrame:
    """(key, model_name, embedding_dim, position): positions run from ``start`` in key order."""
    numbered = ordinals.running_number(
        emb.select(key, F.size(column).alias("embedding_dim"), *([order] if order and order != key else [])),
        [],
        [order or key],
        "_n",
    )
    return numbered.select(
        key, F.lit(model).alias("model_name"), "embedding_dim", (F.col("_n") - 1 + start).alias("position")
    )
