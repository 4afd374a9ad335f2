"""Whole-corpus text cleaning and profiling. Every operator is one projection, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import arrow
from lectern.functions import text as X
from lectern.functions.rows import each


def normalize_unicode(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, arrow.nfkc(F.col(column)))


def unescape_entities(df: DataFrame, column: str = "text") -> DataFrame:
    """HTML entities as characters; run it before sections and tables are read."""
    return df.withColumn(column, arrow.unescape_entities(F.col(column)))


def normalize_whitespace(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, X.collapse_whitespace(F.col(column)))


def mask_pii(df: DataFrame, column: str = "text", types: Sequence[str] | None = None) -> DataFrame:
    """Masks personal data and adds the hits per type (``email_hits``, ...).

    The masks run in the given order, so eight digits become a phone number before the
    national id pattern sees them. Matches are counted only in texts that a mask changed.
    """
    result = df
    for kind in X.pii_types(types):
        result = result.withColumn("_masked", X.mask_one(F.col(column), kind))
        changed = F.col("_masked") != F.col(column)
        hits = F.when(changed, X.pii_hits(F.col(column), kind)).when(~changed, 0)
        result = result.withColumns({f"{kind}_hits": hits, column: F.col("_masked")}).drop("_masked")
    return result


def detect_language(df: DataFrame, column: str = "text", name: str = "language") -> DataFrame:
    return df.withColumn(name, X.language(F.col(column)))


def count_tokens(
    df: DataFrame, column: str = "text", method: str | Column = "whitespace", name: str = "token_count"
) -> DataFrame:
    """Tokens by white space, by character, or by the size of a tokenizer's array column."""
    count = F.size(method) if isinstance(method, Column) else X.token_count(F.col(column), method)
    return df.withColumn(name, count)


def truncate_tokens(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.withColumn(column, X.truncate(F.col(column), n))


def preprocess(
    df: DataFrame,
    column: str = "text",
    normalize: bool = True,
    mask: bool = True,
    types: Sequence[str] | None = None,
    detect: bool = True,
) -> DataFrame:
    """Normalise, mask, detect the language and count; adds lengths before and after."""
    original = F.coalesce(F.col(column), F.lit(""))
    staged = df.withColumns({"original_length": F.length(original), column: original})
    if normalize:
        staged = normalize_whitespace(normalize_unicode(staged, column), column)
    staged = staged.withColumn("_unmasked", F.col(column))
    if mask:
        staged = staged.withColumn(column, X.mask_pii(F.col(column), types))
    return staged.withColumns(
        {
            "processed_length": F.length(column),
            "token_count": X.token_count(F.col(column)),
            "language": X.language(F.col(column)) if detect else F.lit("unknown"),
            "pii_masked": F.col(column) != F.col("_unmasked"),
        }
    ).drop("_unmasked")


def extract_keywords(
    df: DataFrame,
    key: str,
    column: str = "text",
    k: int = 10,
    stop_words: tuple[str, ...] = fixed.KEYWORD_STOP_WORDS,
    min_length: int = 3,
) -> DataFrame:
    """(key, rank, word, count): top words per document, ties by first occurrence.

    Words are counted inside their document's row. Exploding them instead would shuffle
    every distinct (document, word) pair of the corpus.
    """
    counter = arrow.keyword_counter(k, stop_words, min_length)
    counted = df.select(key, counter(X.whitespace_tokens(F.lower(F.col(column)))).alias("words"))
    return each(counted, [key], F.col("words"), "entry", "pos").select(
        key, (F.col("pos") + 1).alias("rank"), F.col("entry.word").alias("word"), F.col("entry.count").alias("count")
    )


def simple_summary(
    df: DataFrame, column: str = "text", max_length: int = fixed.SUMMARY_LENGTH, name: str = "summary"
) -> DataFrame:
    return df.withColumn(name, X.first_sentence_summary(F.col(column), max_length))
