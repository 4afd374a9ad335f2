"""Filters, key lookups, metadata attachment and validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import vectors

METADATA_FIELDS = ("university_id", "program", "year", "aliases", "source_file", "chunk_type")
REQUIRED_METADATA = ("university_id", "program", "year", "chunk_type")
_ISO = (
    r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}(?::\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?(?:[+-]\d{2}:?\d{2})?)?$"
)


def _is_uuid(value: Column) -> Column:
    """32 hex digits once prefixes, braces and dashes are taken away."""
    bare = F.regexp_replace(value, r"urn:|uuid:|^[{}]+|[{}]+$", "")
    return F.rlike(F.replace(bare, F.lit("-"), F.lit("")), F.lit("^[0-9a-fA-F]{32}$"))


def _field(df: DataFrame, key: str) -> Column:
    """A metadata field: nested ``metadata`` first, else a column, else null."""
    key = key.removeprefix("metadata.")
    nested = df.schema["metadata"].dataType if "metadata" in df.columns else None
    if isinstance(nested, T.StructType):
        return F.col("metadata")[key] if key in nested.names else F.lit(None)
    if isinstance(nested, T.MapType):
        return F.col("metadata")[key]
    return F.col(key) if key in df.columns else F.lit(None)


def metadata_predicate(df: DataFrame, filters: Mapping[str, object]) -> Column:
    """Conjunction of equalities; a missing field equals only ``None``."""
    terms = [_field(df, key).eqNullSafe(F.lit(value)) for key, value in filters.items()]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def filter_metadata(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    return df.filter(metadata_predicate(df, filters))


def filter_documents(
    df: DataFrame, university_id: str | None = None, program: str | None = None, year: str | None = None
) -> DataFrame:
    """Keep matching documents; an empty argument does not filter."""
    for column, value in (("university_id", university_id), ("program", program), ("year", year)):
        if value:
            df = df.filter(F.col(column) == value)
    return df


def search_text(
    df: DataFrame, text: str, limit: int | None = 10, literal: bool = True, column: str = "text", order: str = "id"
) -> DataFrame:
    """Rows containing the text without regard to case, first by id.

    ``literal=False`` lets ``%`` and ``_`` act as wildcards.
    """
    if literal:
        matched = df.filter(F.contains(F.lower(F.col(column)), F.lower(F.lit(text))))
    else:
        matched = df.filter(F.col(column).ilike(f"%{text}%"))
    return matched if limit is None else matched.orderBy(order).limit(limit)


# Keys that are sent to every task, at most.
SENT_KEYS = 1 << 16


def joinable(df: DataFrame, key: str, *aggregates) -> DataFrame:
    """One row per key, for a join in which a key may have very many rows on the other side.

    The key is grouped with a hash of itself beside it: the result is the same, but the join then
    gets an exchange of its own on this side as well, without which adaptive execution does not split
    the other side's partition of a hot key.
    """
    return df.groupBy(key, F.xxhash64(key).alias("_beside")).agg(*aggregates).drop("_beside")


def lookup(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows for a table of keys (each key once), with the number of rows that share the key.

    Few keys (counted) are sent to every task, and so are their counts. For many, all keys of the
    table are counted first, and rows of a hot key are split at run time.
    """
    wanted = keys.select(on).dropDuplicates([on])
    if wanted.limit(SENT_KEYS + 1).count() <= SENT_KEYS:
        found = df.join(F.broadcast(wanted), on, "left_semi")
        return found.join(F.broadcast(found.groupBy(on).agg(F.count(F.lit(1)).alias("matches"))), on)
    beside = F.xxhash64(on).alias("_beside")
    counts = df.groupBy(on, beside).agg(F.count(F.lit(1)).alias("matches"))
    matched = counts.join(wanted.select(on, beside), [on, "_beside"], "left_semi").drop("_beside")
    return df.join(matched, on)


def lookup_duplicates(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Keys that match more than one row."""
    return (
        df.join(keys.select(on).dropDuplicates([on]), on, "left_semi")
        .groupBy(on)
        .agg(F.count(F.lit(1)).alias("matches"))
        .filter("matches > 1")
    )


def chunks_of(df: DataFrame, documents: object, column: str = "document_id", order: str = "chunk_index") -> DataFrame:
    """Chunks of one document (by value) or of a table of documents, in order."""
    if isinstance(documents, DataFrame):
        kept = df.join(documents.select(column).distinct(), column, "left_semi")
        return kept.orderBy(column, order)
    return df.filter(F.col(column) == documents).orderBy(order)


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in order. Aggregates before the shuffle."""
    values = [c for c in df.columns if c != key]
    latest = joinable(df, key, F.max_by(F.struct(*values), F.col(order)).alias("_row"))
    return latest.select(key, "_row.*")


def attach_by_key(hits: DataFrame, meta: DataFrame, key: str, order: str) -> DataFrame:
    """Left join of metadata by key; the last duplicate of a key wins."""
    return hits.join(last_by_key(meta, key, order), key, "left")


def normalize_metadata(df: DataFrame) -> DataFrame:
    """The six metadata fields with their defaults; a scalar alias becomes a one-element list."""
    aliases = _field(df, "aliases")
    kind = None
    if "metadata" in df.columns and isinstance(df.schema["metadata"].dataType, T.StructType):
        names = df.schema["metadata"].dataType
        kind = names["aliases"].dataType if "aliases" in names.names else None
    elif "aliases" in df.columns:
        kind = df.schema["aliases"].dataType
    if isinstance(kind, T.StringType):
        aliases = F.when(aliases.isNotNull(), F.array(aliases))
    elif not isinstance(kind, T.ArrayType):
        aliases = F.lit(None).cast("array<string>")
    defaults = {"chunk_type": "unknown"}
    columns = []
    for name in METADATA_FIELDS:
        if name == "aliases":
            value = F.coalesce(aliases, F.array().cast("array<string>"))
        else:
            value = F.coalesce(_field(df, name).cast("string"), F.lit(defaults.get(name, "")))
        columns.append(value.alias(name))
    kept = [c for c in df.columns if c not in (*METADATA_FIELDS, "metadata")]
    return df.select(*kept, *columns)


def merge_metadata(base: DataFrame, override: DataFrame, on: str) -> DataFrame:
    """Base rows with every non-null override value; override-only columns are added."""
    b, o = base.alias("b"), override.alias("o")
    columns = [F.col(f"b.{on}")]
    for name in base.columns:
        if name == on:
            continue
        if name in override.columns:
            columns.append(F.coalesce(F.col(f"o.{name}"), F.col(f"b.{name}")).alias(name))
        else:
            columns.append(F.col(f"b.{name}"))
    columns += [F.col(f"o.{name}") for name in override.columns if name not in base.columns]
    return b.join(o, F.col(f"b.{on}") == F.col(f"o.{on}"), "left").select(*columns)


def merge_maps(base: Column, override: Column) -> Column:
    """Map form of the merge: non-null override entries replace or extend the base."""
    changes = F.map_filter(F.coalesce(override, F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(changes, k))
    return F.map_concat(kept, changes)


def validate_metadata(df: DataFrame, required: Sequence[str] = REQUIRED_METADATA) -> DataFrame:
    """Adds ``missing`` (absent required fields) and ``valid``; split with a filter on ``valid``."""
    missing = F.array_compact(F.array(*[F.when(_field(df, f).isNull(), F.lit(f)) for f in required]))
    return df.withColumn("missing", missing).withColumn("valid", F.size("missing") == 0)


def validate_embeddings(df: DataFrame, column: str = "embedding", dim: int | None = None) -> DataFrame:
    """Adds ``reason``: null for a good vector, else ``missing``, ``not finite`` or ``dimension``.

    Without ``dim`` the most frequent dimension is expected; that one number is counted
    first, per task and then per dimension.
    """
    vector = F.col(column)
    if dim is None:
        sizes = df.filter(vector.isNotNull()).groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n"))
        dim = sizes.agg(F.max_by("d", F.struct("n", "d"))).first()[0]
    return df.withColumn(
        "reason",
        F.when(vector.isNull(), "missing")
        .when(F.size(vector) != F.lit(dim), "dimension")
        .when(~vectors.finite(vector), "not finite"),
    )


def validate_questions(df: DataFrame) -> DataFrame:
    """Adds ``missing``, ``reason`` and ``valid`` to question records."""
    required = ("question_id", "timestamp", "original_question", "processed_question")
    checked = validate_metadata(df, required).drop("valid")
    stamp = F.replace(F.col("timestamp").cast("string"), F.lit("Z"), F.lit("+00:00"))
    reason = (
        F.when(F.size("missing") > 0, F.concat(F.lit("missing "), F.array_join("missing", ", ")))
        .when(~_is_uuid(F.col("question_id")), F.lit("question_id is no UUID"))
        .when(~F.rlike(stamp, F.lit(_ISO)) | F.try_to_timestamp(stamp).isNull(), F.lit("timestamp is not ISO"))
    )
    return checked.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
