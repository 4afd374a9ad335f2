"""Intent, entities and question records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import arrow
from lectern.functions import text as X
from lectern.functions.rows import each
from lectern.operators import cleaning

ENTITY_TYPES = tuple(fixed.ENTITY_PATTERNS_REFERENCE)


def classify_intent(df: DataFrame, column: str = "text", rules=None, threshold: float = 0.5) -> DataFrame:
    """Adds ``intent`` and ``intent_confidence``."""
    return df.withColumn("_intent", X.best_intent(F.col(column), rules, threshold)).select(
        *df.columns, "_intent.intent", "_intent.intent_confidence"
    )


def extract_entities(df: DataFrame, key: str, column: str = "text", rules: str | dict = "default") -> DataFrame:
    """Long form (key, type, subtype, value, start, end); matches of one type do not overlap."""
    finder = arrow.entity_finder(rules)
    return each(df, [key], finder(F.col(column)), "entity").select(key, "entity.*")


def entity_counts(entities: DataFrame, key: str, types=ENTITY_TYPES) -> DataFrame:
    """One row per key with a count per entity type and the total."""
    counts = [F.count_if(F.col("type") == t).alias(t) for t in types]
    return entities.groupBy(key).agg(*counts, F.count(F.lit(1)).alias("entity_count"))


def entity_map(entities):
    """array of matches -> map<type, array<struct<value, type>>>."""
    kinds = F.array_distinct(F.transform(entities, lambda e: e["type"]))

    def of(kind):
        same = F.filter(entities, lambda e: e["type"] == kind)
        return F.transform(same, lambda e: F.struct(e["value"].alias("value"), e["subtype"].alias("type")))

    return F.map_from_arrays(kinds, F.transform(kinds, of))


def analyse_questions(df: DataFrame, column: str = "question", rules: str | dict = "default") -> DataFrame:
    """Deterministic part of a question record; also valid on a stream.

    Blank questions keep zero counts, intent ``unknown`` and an error reason.
    """
    empty = X.blank(F.col(column))
    staged = df.withColumns({"original_question": F.col(column), "processed_question": F.col(column)})
    staged = cleaning.preprocess(staged, "processed_question")
    staged = staged.withColumn("_intent", X.best_intent(F.col("processed_question")))
    staged = staged.withColumn("_entities", arrow.entity_finder(rules)(F.col("processed_question")))
    return staged.select(
        *df.columns,
        "original_question",
        F.when(empty, F.col("original_question")).otherwise(F.col("processed_question")).alias("processed_question"),
        F.struct(
            F.when(empty, F.lit("Empty question")).alias("error"),
            F.when(empty, F.lit("")).otherwise(F.col("processed_question")).alias("text"),
            F.when(empty, F.lit(0)).otherwise(F.col("original_length")).alias("original_length"),
            F.when(empty, F.lit(0)).otherwise(F.col("processed_length")).alias("processed_length"),
            F.col("token_count"),
            F.col("language"),
            F.col("pii_masked"),
        ).alias("preprocessing"),
        F.when(empty, F.lit("unknown")).otherwise(F.col("_intent.intent")).alias("intent"),
        F.when(empty, F.lit(0.0)).otherwise(F.col("_intent.intent_confidence")).alias("intent_confidence"),
        entity_map(F.coalesce(F.col("_entities"), F.array())).alias("entities"),
    )


def make_question_records(df: DataFrame, column: str = "question", rules: str | dict = "default") -> DataFrame:
    """Question records with a random id and the current time (UTC)."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    records = analyse_questions(df, column, rules)
    for optional in ("user_id", "session_id"):
        if optional not in records.columns:
            records = records.withColumn(optional, F.lit(None).cast("string"))
    return records.withColumns({"question_id": F.uuid(), "timestamp": F.concat(now, F.lit("Z"))})
