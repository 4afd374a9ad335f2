"""Stored text indexes: term postings for lexical search and trigram postings for substring search.

Both are built once from the texts; a search then reads postings, not texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import text as X
from lectern.functions.arrow import bounded
from lectern.functions.rows import each
from lectern.operators import filters as flt
from lectern.operators.ordinals import top_rows
from lectern.operators.retrieval import SCORE_DECIMALS
from lectern.session import scratch_path
from lectern.sources.store import stored

# Postings of a block: the unit that a search reads or skips.
BLOCK_POSTINGS = 256
# Rows of a side that is sent to every task, at most.
SENT_ROWS = 1 << 18
# Scores that differ by less are the same after rounding.
_SLACK = 10.0**-SCORE_DECIMALS


@dataclass(frozen=True)
class PostingIndex:
    """Blocks of postings and the figures that weights need.

    A term's postings lie in ``blocks`` blocks by a hash of the item, so the block of an item is known without a search.
    """

    blocks: DataFrame  # term, no, impact, n, items, tf, length
    terms: DataFrame  # term, df, blocks, impact
    items: int
    mean_length: float
    k1: float
    b: float


def _saturated(tf: Column, length: Column, mean_length: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / max(mean_length, 1e-9)))


def _number(item: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(item), F.col(blocks)).cast("long")


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``term, item_id, length, tf`` from one row per text: the words of a text are counted where it lies."""
    for batch in batches:
        for part in bounded(batch):
            tokens = part.column("tokens")
            words = tokens.flatten().dictionary_encode()
            n = len(words.dictionary)
            if not n:
                continue
            rows = np.repeat(np.arange(part.num_rows), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            cells, tf = np.unique(rows * n + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            own = pa.array(cells // n)
            yield pa.RecordBatch.from_arrays(
                [words.dictionary.take(pa.array(cells % n)).cast(pa.string()), part.column("item_id").take(own), part.column("length").take(own), pa.array(tf.astype(np.int32))],
                names=["term", "item_id", "length", "tf"],
            )


def _sent(df: DataFrame) -> DataFrame:
    """A written table, marked to be sent to every task if it has few rows."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from rows sorted by term and block; a block on the edge of a batch becomes two with the same number."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        term, no = batch.column("term"), batch.column("no").to_numpy()
        code = term.dictionary_encode().indices.to_numpy()
        new = np.ones(n, bool)
        new[1:] = (code[1:] != code[:-1]) | (no[1:] != no[:-1])
        cut = np.flatnonzero(new)
        edges = np.append(cut, n).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(edges), batch.column(c)) for c in ("item_id", "tf", "length")]
        impact = np.maximum.reduceat(batch.column("impact").to_numpy(), cut)
        yield pa.RecordBatch.from_arrays(
            [term.take(pa.array(cut)), pa.array(no[cut]), pa.array(impact), pa.array(np.diff(edges)), *lists],
            names=["term", "no", "impact", "n", "items", "tf", "length"],
        )


def postings_store(items: DataFrame, path: str, k1: float = 1.2, b: float = 0.75, block_postings: int = BLOCK_POSTINGS) -> PostingIndex:
    """Writes the postings of ``items`` (``item_id, text``) below ``path`` and returns the index.

    Frequencies are counted in each text's row, so postings are shuffled once, to be sorted. Range partitioning by term, block and
    item cuts a frequent term over several files, each sorted, so that a file tells which terms it holds. Blocks hold
    about ``block_postings`` postings and their greatest impact.
    """
    spark = items.sparkSession
    tokens = items.select("item_id", X.whitespace_tokens(F.lower(F.col("text"))).alias("tokens")).withColumn("length", F.size("tokens"))
    total = tokens.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean_length"))
    total.select("*", F.lit(k1).alias("k1"), F.lit(b).alias("b")).write.parquet(f"{path}/totals")
    mean_length = spark.read.parquet(f"{path}/totals").first()["mean_length"]
    kind = items.schema["item_id"].dataType.simpleString()
    counted = tokens.mapInArrow(_frequencies, f"term string, item_id {kind}, length int, tf int")
    # Texts of one id and length count as one item; such ids are the exception.
    twice = stored(items.groupBy("item_id").count().filter("count > 1").select("item_id"), scratch_path(spark, "twice"))
    if not twice.isEmpty():
        same = counted["item_id"].eqNullSafe(twice["item_id"])
        met = counted.join(twice, same, "left_semi").groupBy("term", "item_id", "length").agg(F.sum("tf").cast("int").alias("tf"))
        counted = counted.join(twice, same, "left_anti").unionByName(met)
    weighed = stored(counted.withColumn("impact", _saturated(F.col("tf"), F.col("length"), mean_length, k1, b)), scratch_path(spark, "weighed"))
    weighed.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.ceil(F.count(F.lit(1)) / block_postings).alias("blocks"), F.max("impact").alias("impact")
    ).write.parquet(f"{path}/terms")
    # Most terms have one block, whose number is 0; only the others are looked up.
    sizes = _sent(spark.read.parquet(f"{path}/terms").filter("blocks > 1").select("term", "blocks"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["term", "no", "item_id"]
    number = F.coalesce(_number("item_id", "blocks"), F.lit(0).cast("long"))
    placed = weighed.join(sizes, "term", "left").select("term", number.alias("no"), "item_id", "tf", "length", "impact")
    placed.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(
        _cut, f"term string, no long, impact double, n int, items array<{kind}>, tf array<int>, length array<int>"
    ).write.parquet(f"{path}/blocks")
    return postings_load(spark, path)


def postings_load(spark, path: str) -> PostingIndex:
    total = spark.read.parquet(f"{path}/totals").first()
    return PostingIndex(
        spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms"), total["items"], total["mean_length"], total["k1"], total["b"]
    )


def _contributions(index: PostingIndex, wanted: DataFrame) -> DataFrame:
    """``query_id, item_id, part`` for the postings of ``wanted`` (``query_id, term, no, weight``)."""
    wanted = stored(wanted, scratch_path(wanted.sparkSession, "wanted"))
    # Blocks of other terms are left where they lie, also where much is wanted.
    asked = stored(wanted.select("term").distinct(), scratch_path(wanted.sparkSession, "asked"))
    blocks = index.blocks.select("term", "no", "items", "tf", "length").join(_sent(asked), "term", "left_semi")
    read = blocks.join(_sent(wanted), ["term", "no"])
    rows = each(read, ["query_id", "weight"], F.arrays_zip("items", "tf", "length"), "p")
    saturated = _saturated(F.col("p.tf"), F.col("p.length"), index.mean_length, index.k1, index.b)
    return rows.select("query_id", F.col("p.items").alias("item_id"), (saturated * F.col("weight")).alias("part"))


def _scores(parts: DataFrame) -> DataFrame:
    return parts.groupBy("query_id", "item_id").agg(F.sum("part").alias("score"))


@dataclass(frozen=True)
class _Plan:
    """What a search reads: blocks by ``query_id, term, no, weight``, and what the leading ones gave."""

    leading: DataFrame
    scores: DataFrame
    following: DataFrame


def _planned(index: PostingIndex, queries: DataFrame, k: int) -> _Plan:
    """Blocks of the terms of each query that a hit can lie in.

    The best block of each term gives ``k`` items a least score. Terms whose best impacts together stay below it
    follow: an item that has only these is no hit. Of the leading terms a block is read if its impact and
    the best of all other terms reach the least score; of the following ones the blocks of items that the leading ones
    left within reach. An item at or above the least score loses no block, and every other item's sum only
    falls short, so hits and scores are exact.
    """
    spark = queries.sparkSession
    asked = each(queries, ["query_id"], F.array_distinct(X.whitespace_tokens(F.lower(F.col("text")))), "term")
    weight = F.log1p((F.lit(index.items) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # A query's words are few, so the window is small.
    rising = Window.partitionBy("query_id").orderBy("best", "term").rowsBetween(Window.unboundedPreceding, 0)
    terms = stored(
        asked.join(index.terms, "term")
        .select("query_id", "term", "blocks", weight.alias("weight"), (weight * F.col("impact")).alias("best"))
        .select("*", F.sum("best").over(rising).alias("up_to"), F.sum("best").over(Window.partitionBy("query_id")).alias("most")),
        scratch_path(spark, "terms"),
    )
    heads = index.blocks.select("term", "no", F.col("impact").alias("reach"))
    met = heads.join(_sent(terms), "term").withColumn("own", F.col("reach") * F.col("weight"))
    first = top_rows(met.select("query_id", "term", "no", "weight", "own"), ["query_id", "term"], [F.col("own").desc(), F.col("no")], 1)
    known = top_rows(_scores(_contributions(index, first.select("query_id", "term", "no", "weight"))), ["query_id"], [F.col("score").desc(), F.col("item_id")], k)
    least = stored(known.filter(F.col("rank") == k).select("query_id", (F.col("score") - _SLACK).alias("least")), scratch_path(spark, "least"))
    follows = F.col("least").isNotNull() & (F.col("up_to") < F.col("least"))
    in_reach = F.col("least").isNull() | (F.col("own") + F.col("most") - F.col("best") >= F.col("least"))
    leading = met.join(least, "query_id", "left").filter(~follows & in_reach).select("query_id", "term", "no", "weight").distinct()
    scores = stored(_scores(_contributions(index, leading)), scratch_path(spark, "scores"))
    later = terms.join(least, "query_id").filter(follows).select("query_id", "term", "blocks", "weight", "best", "least")
    rest = later.groupBy("query_id").agg(F.sum("best").alias("rest"), F.max("least").alias("least"))
    left = scores.join(rest, "query_id").filter(F.col("score") + F.col("rest") >= F.col("least")).select("query_id", "item_id")
    following = (
        left.join(later.select("query_id", "term", "blocks", "weight"), "query_id")
        .select("query_id", "term", _number("item_id", "blocks").alias("no"), "weight")
        .distinct()
    )
    return _Plan(leading, scores, following)


def bm25_stored(index: PostingIndex, queries: DataFrame, k: int = fixed.RETRIEVAL_K) -> DataFrame:
    """Top-k by BM25, equal to :func:`retrieval.bm25` over the indexed items, without reading their texts.

    Repeated words of a query count once, and a query without a known word has no hit. Blocks that cannot hold a hit are
    not read; postings meet queries by term and block, so no term is a hot key.
    """
    plan = _planned(index, queries, k)
    later = _contributions(index, plan.following)
    both = _scores(plan.scores.withColumnRenamed("score", "part").unionByName(later))
    scored = both.withColumn("score", F.round("score", SCORE_DECIMALS)).filter("score > 0")
    return top_rows(scored, ["query_id"], [F.col("score").desc(), F.col("item_id")], k)


def blocks_read(index: PostingIndex, queries: DataFrame, k: int = fixed.RETRIEVAL_K) -> DataFrame:
    """One row: ``all_blocks`` of the terms of each query and ``read_blocks`` of them that a search reads."""
    plan = _planned(index, queries, k)
    asked = each(queries, ["query_id"], F.array_distinct(X.whitespace_tokens(F.lower(F.col("text")))), "term")
    every = asked.join(index.terms, "term").agg(F.sum("blocks").alias("all_blocks"))
    read = plan.leading.unionByName(plan.following).distinct().agg(F.count(F.lit(1)).alias("read_blocks"))
    return every.join(F.broadcast(read))


# ---- substring search ---------------------------------------------------------------------


@dataclass(frozen=True)
class TrigramIndex:
    """Texts in slots by id, the ids of each trigram, and how many there are."""

    texts: DataFrame
    postings: DataFrame  # trigram, id
    counts: DataFrame  # trigram, n
    column: str
    key: str
    slots: int


def trigrams(text: str) -> np.ndarray:
    """Distinct runs of three code points, each as one whole number of 63 bits."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:]) if len(points) > 2 else np.zeros(0, np.int64)


def _postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column("text")[i].as_py()
            found = trigrams(text) if text else np.zeros(0, np.int64)
            if len(found):
                own = batch.column("id").take(pa.array(np.full(len(found), i)))
                yield pa.RecordBatch.from_arrays([pa.array(found), own], names=["trigram", "id"])


def _slot(key: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def trigram_store(df: DataFrame, path: str, column: str = "text", key: str = "id", slots: int = 64) -> TrigramIndex:
    """Writes the rows of ``df`` by slot and the trigrams of their lower-cased texts below ``path``."""
    spark = df.sparkSession
    df.withColumn("slot", _slot(key, slots)).repartition(slots, "slot").write.partitionBy("slot").parquet(f"{path}/texts")
    kind = df.schema[key].dataType.simpleString()
    found = df.select(F.col(key).alias("id"), F.lower(F.col(column)).alias("text")).mapInArrow(_postings, f"trigram long, id {kind}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A frequent trigram is cut over files by id; every file tells the trigrams it holds.
    found.repartitionByRange(parts, "trigram", "id").sortWithinPartitions("trigram", "id").write.parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    postings.groupBy("trigram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange(parts, "trigram").sortWithinPartitions("trigram").write.parquet(f"{path}/counts")
    return trigram_load(spark, path, column, key, slots)


def trigram_load(spark, path: str, column: str = "text", key: str = "id", slots: int = 64) -> TrigramIndex:
    texts, postings, counts = (spark.read.parquet(f"{path}/{name}") for name in ("texts", "postings", "counts"))
    return TrigramIndex(texts, postings, counts, column, key, slots)


# Trigrams of a literal whose postings are intersected, rarest first; the exact test does the rest.
MET_TRIGRAMS = 4


def candidates(index: TrigramIndex, text: str) -> DataFrame | None:
    """``id`` of rows that hold the rarest trigrams of the lower-cased ``text``; None for a literal of fewer than three characters."""
    spark = index.texts.sparkSession
    lowered = spark.range(1).select(F.lower(F.lit(text)).alias("text")).first()["text"]
    wanted = [int(t) for t in trigrams(lowered)]
    if not wanted:
        return None
    counts = {r["trigram"]: r["n"] for r in index.counts.filter(F.col("trigram").isin(wanted)).collect()}
    if len(counts) < len(wanted):
        return index.postings.select("id").limit(0)
    rarest = sorted(wanted, key=lambda t: (counts[t], t))[:MET_TRIGRAMS]
    met = index.postings.filter(F.col("trigram").isin(rarest)).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return met.filter(F.col("n") == len(rarest)).select("id")


def search_text_stored(index: TrigramIndex, text: str, limit: int | None = 10, order: str = "id") -> DataFrame:
    """As :func:`filters.search_text` with a literal, reading only the slots in which a row can match.

    The slots of candidates (a fixed number) become a filter on folders of the texts. Literals of fewer than
    three characters have no trigram and are looked for in all texts.
    """
    found = candidates(index, text)
    plain = index.texts.drop("slot")
    if found is None:
        return flt.search_text(plain, text, limit, True, index.column, order)
    found = stored(found.withColumn("slot", _slot("id", index.slots)), scratch_path(index.texts.sparkSession, "candidates"))
    slots = [r["slot"] for r in found.select("slot").distinct().collect()]
    texts = index.texts.filter(F.col("slot").isin(slots)) if slots else index.texts.limit(0)
    near = texts.join(found.select(F.col("id").alias(index.key)), index.key, "left_semi")
    return flt.search_text(near.drop("slot"), text, limit, True, index.column, order)
