"""Language identification by character trigram profiles that are learned from labelled rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.arrow import bounded
from lectern.session import scratch_path
from lectern.sources.store import stored

PROFILE_SIZE = 400
# Profile rows (a trigram, a language, a number) that are sent to every task, at most.
SENT_ROWS = 1 << 18
# What is no letter; letters beyond the basic plane count as none, as a pattern may stop inside them.
NO_LETTERS = r"[^\p{L}]+|[\x{10000}-\x{10FFFF}]+"


def letters(text: Column) -> Column:
    """The lower-cased letters, runs of anything else being one blank, with a blank at both ends."""
    found = F.trim(F.regexp_replace(F.lower(text), NO_LETTERS, " "))
    return F.concat(F.lit(" "), F.regexp_replace(found, " +", " "), F.lit(" "))


def count_trigrams(texts: pa.Array, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, trigram and count of the three neighbouring characters in the texts of each group, by group and trigram.

    A trigram is one number of three times 16 bits: letters beyond the basic plane are no letters here. The characters that
    occur are numbered, so that a group and a trigram make one number to sort by.
    """
    texts = pc.fill_null(texts, "")
    units = np.frombuffer("".join(texts.to_pylist()).encode("utf-16-le"), np.uint16)
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    whole = np.ones(len(units), bool)
    for back in (1, 2):
        whole[(ends - back)[lengths >= back]] = False
    begins = np.flatnonzero(whole)
    known = np.flatnonzero(np.bincount(units, minlength=1))
    place = np.zeros(1 << 16, np.int64)
    place[known] = np.arange(len(known))
    at, size = place[units], max(1, len(known))
    if groups * size**3 >= 1 << 63:
        raise ValueError(f"{groups} groups are too many to count at once")
    keys = np.repeat(group, np.maximum(lengths - 2, 0)) * size**3
    keys += at[begins] * size**2 + at[begins + 1] * size + at[begins + 2]
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    n, keys = np.diff(np.append(first, len(keys))), keys[first]
    grams = np.zeros(len(keys), np.int64)
    for power in (2, 1, 0):
        grams = (grams << 16) | known[keys // size**power % size]
    return keys // size**3, grams, n


# Rows that are counted at once, at most: with any three characters they make one number below 2^63.
_ROWS = 1 << 14


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in bounded(batch):
            for low in range(0, part.num_rows, _ROWS):
                yield part.slice(low, _ROWS)


def _by_label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        labels = part.column("language").dictionary_encode()
        group, grams, n = count_trigrams(part.column("text"), labels.indices.to_numpy().astype(np.int64), len(labels.dictionary))
        yield pa.RecordBatch.from_arrays([labels.dictionary.take(pa.array(group)), pa.array(grams), pa.array(n)], names=["language", "gram", "n"])


def _by_row(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each row; a row without trigrams comes once, with none."""
    for part in _parts(batches):
        rows = part.num_rows
        row, grams, n = count_trigrams(part.column("text"), np.arange(rows), rows)
        bare = np.flatnonzero(np.bincount(row, minlength=rows) == 0)
        keys = part.column("_key").take(pa.array(np.concatenate([row, bare])))
        found = pa.array(np.concatenate([grams, bare]), mask=np.arange(len(keys)) >= len(grams))
        yield pa.RecordBatch.from_arrays([keys, found, pa.array(np.concatenate([n, np.zeros_like(bare)]))], names=["_key", "gram", "n"])


def learn_profiles(df: DataFrame, column: str = "text", label: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """(language, gram, weight): the ``size`` most frequent trigrams of each label, the first weighing ``size``, the last 1.

    Rows without label or text teach nothing; ties go to the smaller trigram. Counts are added up in each task before
    (label, trigram) pairs are shuffled, and only the first rows of each label in each task reach the ranking.
    """
    kind = df.schema[label].dataType.simpleString()
    counted = (
        df.filter(F.col(label).isNotNull())
        .select(F.col(label).alias("language"), letters(F.col(column)).alias("text"))
        .mapInArrow(_by_label, f"language {kind}, gram long, n long")
        .groupBy("language", "gram")
        .agg(F.sum("n").alias("count"))
    )
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("count"), "gram"))
    ranked = counted.withColumn("rank", rank).filter(F.col("rank") <= size)
    spelt = F.decode(F.unhex(F.lpad(F.hex("gram"), 12, "0")), "UTF-16BE")
    return ranked.select("language", spelt.alias("gram"), (F.lit(size + 1) - F.col("rank")).cast("long").alias("weight"))


def identify(df: DataFrame, key: str, profiles: DataFrame, column: str = "text", sent: int = SENT_ROWS) -> DataFrame:
    """(key, language, score): the profile whose weights add up to most over all trigrams of the whole text.

    Keys tell rows apart. Ties go to the smaller language; a text that meets no profile, a null or an empty one is
    ``unknown`` with score 0. Profiles are counted: up to ``sent`` rows of them go to every task, so trigrams are never
    shuffled, only sums per row and language; more profiles are joined by trigram. A trigram of a row is looked up once,
    with its count.
    """
    few = profiles.limit(sent + 1).count() <= sent
    kind = df.schema[key].dataType.simpleString()
    grams = df.select(F.col(key).alias("_key"), letters(F.col(column)).alias("text")).mapInArrow(_by_row, f"_key {kind}, gram long, n long")
    digits = F.hex(F.encode("gram", "UTF-16BE"))
    # Only three characters of 16 bits can meet a trigram of a text.
    numbered = profiles.select("language", F.when(F.length(digits) == 12, F.conv(digits, 16, 10).cast("long")).alias("gram"), "weight")
    met = grams.join(F.broadcast(numbered) if few else numbered, "gram", "left")
    sums = met.groupBy("_key", "language").agg(F.sum(F.col("weight") * F.col("n")).alias("score"))
    best = F.min(F.when(F.col("language").isNotNull(), F.struct((-F.col("score")).alias("less"), "language")))
    return sums.groupBy("_key").agg(best.alias("best")).select(
        F.col("_key").alias(key),
        F.coalesce("best.language", F.lit("unknown")).alias("language"),
        F.coalesce(-F.col("best.less"), F.lit(0)).cast("long").alias("score"),
    )


def learned(df: DataFrame, column: str = "text", label: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """:func:`learn_profiles`, written once below the session's shared folder."""
    return stored(learn_profiles(df, column, label, size), scratch_path(df.sparkSession, "profiles"))
