"""Benchmark decontamination by SimHash windows, Hamming blocks and exact shingle similarity.

A document is read in windows of exactly an item's number of words. A window's SimHash is looked up
among the items of that size by blocks of its bits: if two fingerprints differ in at most ``radius``
bits, some block differs in at most ``radius // BLOCKS``, and each block value lists all items that
near. Whatever is found is verified by the exact weighted similarity of five-word shingles (sum of
the smaller over sum of the larger counts).

A window can only reach the threshold if enough of its shingles occur in the benchmark at all; the
windows that fail this exact bound get no fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import numbered, row_number, text_or_empty, without_rows, written
from lectern.llm.words import PUNCTUATION, chunks, find_words, sequence_hashes

SHINGLE = 5
THRESHOLD = 0.8
BITS = 64
BLOCKS = 8
# Expected distance at the threshold is about ten bits; this is more than four deviations above.
RADIUS = 23
# Benchmark text that one pass over the documents carries along.
PASS_BYTES = 16 << 20
ODD_MARKS = r"[\u0080-©«-±´¶-¸»¿ -⁯⸀-⹿　-〠]"


def plain(name: str):
    """Lower-cased text in which punctuation outside ASCII is a blank; ASCII punctuation parts words later."""
    text = F.lower(text_or_empty(name))
    return F.when(text.rlike(ODD_MARKS), F.regexp_replace(text, ODD_MARKS, " ")).otherwise(text)


def simhashes(grams: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of eight bytes for rows of shingle hashes: the majority of each bit."""
    bits = np.unpackbits(np.ascontiguousarray(grams).view(np.uint8).reshape(*grams.shape, 8), axis=-1)
    return np.packbits(2 * bits.sum(-2, dtype=np.int64) > grams.shape[-1], axis=-1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two lists of shingle hashes."""
    both, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(both)), np.bincount(at[len(a) :], minlength=len(both))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class BlockIndex:
    """Fingerprints found by any that lies within the radius."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        values = np.arange(256, dtype=np.uint8)
        self.lists = []
        for b in range(BLOCKS):
            near = np.bitwise_count(values[:, None] ^ prints[None, :, b]) <= radius // BLOCKS
            value, item = np.nonzero(near)
            self.lists.append((np.searchsorted(value, np.arange(257)), item))

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``prints``, indexed item) at most ``radius`` bits apart."""
        codes = []
        for b, (bounds, items) in enumerate(self.lists):
            low, high = bounds[prints[:, b]], bounds[prints[:, b].astype(int) + 1]
            n = high - low
            row = np.repeat(np.arange(len(prints)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            codes.append(row * len(self.prints) + items[low[row] + nth])
        found = np.unique(np.concatenate(codes))
        row, item = found // len(self.prints), found % len(self.prints)
        within = distances(prints[row], self.prints[item]) <= self.radius
        return row[within], item[within]


class Benchmark:
    """Items by their number of words, with shingles, fingerprints and block indexes."""

    def __init__(self, ids: list, texts: list[str], threshold: float = THRESHOLD, radius: int = RADIUS):
        self.threshold = threshold
        found = find_words(pa.array(texts, pa.large_string()), separator=PUNCTUATION)
        by_size: dict[int, list[tuple]] = {}
        for i, item in enumerate(ids):
            own = found.hashes[found.bounds[i] : found.bounds[i + 1]]
            if len(own):
                by_size.setdefault(len(own), []).append((item, sequence_hashes(own, min(SHINGLE, len(own)))))
        self.sizes = {}
        for size, items in sorted(by_size.items()):
            index = BlockIndex(np.concatenate([simhashes(g[None]) for _, g in items]), radius)
            self.sizes[size] = ([i for i, _ in items], [g for _, g in items], index)
        self.known = {}
        for gram in {min(SHINGLE, size) for size in self.sizes}:
            self.known[gram] = np.unique(np.concatenate([g for s, (_, gs, _) in self.sizes.items() if min(SHINGLE, s) == gram for g in gs]))

    def marks(self, rolled: np.ndarray, gram: int) -> np.ndarray:
        """Which shingle positions hold a shingle of the benchmark."""
        known = self.known[gram]
        low = np.zeros(1 << 16, bool)
        low[(known & np.uint64(0xFFFF)).astype(int)] = True
        found = np.flatnonzero(low[(rolled & np.uint64(0xFFFF)).astype(int)])
        at = np.minimum(np.searchsorted(known, rolled[found]), len(known) - 1)
        marks = np.zeros(len(rolled), bool)
        marks[found[known[at] == rolled[found]]] = True
        return marks

    def search(self, grams: np.ndarray, marks: np.ndarray, gram: int, size: int) -> Iterator[tuple]:
        """(item, similarity, first word, words) of the windows of one document that reach the threshold.

        A document shorter than the item is one window.
        """
        ids, shingles, index = self.sizes[size]
        wide = min(size - gram + 1, len(grams))
        full = size - gram + 1
        # Common weight c of totals w and v gives c / (w + v - c); c is at most the marked shingles.
        need = self.threshold * (wide + full) / (1 + self.threshold)
        held = np.concatenate([[0], np.cumsum(marks)])
        starts = np.flatnonzero(held[wide:] - held[:-wide] >= need - 1e-9)
        for i in range(0, len(starts), 256):
            rows = grams[starts[i : i + 256, None] + np.arange(wide)]
            for row, item in zip(*index.find(simhashes(rows)), strict=True):
                reached = similarity(rows[row], shingles[item])
                if reached >= self.threshold:
                    yield ids[item], reached, int(starts[i + row]), wide + gram - 1


def _scan(benchmark: Benchmark, id_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            found = find_words(chunk.column("text"), separator=PUNCTUATION)
            rows, best = chunk.column("row").to_pylist(), {}
            for gram in benchmark.known:
                rolled = sequence_hashes(found.hashes, gram)
                marks = benchmark.marks(rolled, gram)
                hit = np.flatnonzero(marks)
                for doc in np.unique(np.searchsorted(found.bounds, hit, "right") - 1).tolist():
                    a, b = int(found.bounds[doc]), int(found.bounds[doc + 1]) - gram + 1
                    held = int(marks[a:b].sum()) if b > a else 0
                    for size in benchmark.sizes:
                        if min(SHINGLE, size) != gram or held < benchmark.threshold * (size - gram + 1) / (1 + benchmark.threshold):
                            continue
                        for item, reached, start, words in benchmark.search(rolled[a:b], marks[a:b], gram, size):
                            if (doc, item) not in best or reached > best[doc, item][0]:
                                best[doc, item] = (reached, start, words)
            keys = list(best)
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("id").take(pa.array([d for d, _ in keys], pa.int64())),
                    pa.array([rows[d] for d, _ in keys], pa.int64()),
                    pa.array([i for _, i in keys], id_type),
                    pa.array([best[k][0] for k in keys], pa.float64()),
                    pa.array([best[k][1] for k in keys], pa.int64()),
                    pa.array([best[k][2] for k in keys], pa.int64()),
                ],
                names=["doc_id", "row", "item_id", "similarity", "first_word", "n_words"],
            )

    return run


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document and benchmark item found in it: ``doc_id, row, item_id, similarity, first_word, n_words``.

    Words are runs of letters and digits of the lower-cased text, so passages are found whatever
    their case and punctuation. Of several windows the most similar, then the first, is told;
    ``first_word`` counts the document's words from 0. An item of fewer than five words is one
    shingle; a document shorter than an item is compared as a whole. Null and empty texts are
    never contaminated, null or empty items match nothing, repeated rows and items are told each.
    Other columns are not read. Documents are read once, without a shuffle; a benchmark of more than
    ``PASS_BYTES`` is taken in several passes.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), plain(item_text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    passes = -(-int(total) // PASS_BYTES)
    read = docs.select(
        row_number(docs).alias("row"), F.col(id_col).alias("id"), plain(text_col).alias("text")
    )
    kinds, item_kind = dict(docs.dtypes), dict(benchmark.dtypes)[item_col]
    schema = f"doc_id {kinds[id_col]}, row long, item_id {item_kind}, similarity double, first_word long, n_words long"
    parts = []
    for i in range(passes):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == i).toArrow()
        known = Benchmark(own.column("item").to_pylist(), own.column("text").to_pylist(), threshold)
        if known.sizes:
            parts.append(read.mapInArrow(_scan(known, own.schema.field("item").type), schema))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows in which no benchmark item is found, with all their columns; an empty table stays empty."""
    docs = numbered(docs)
    found = contaminated(docs, benchmark, threshold)
    return without_rows(docs, written(found.select("row").distinct(), "contaminated"))
