"""Substring deduplication with prefix-partitioned suffix trees.

Suffixes that begin a repeated window are the only ones worth a tree. Every window of ``window`` words
names one of its positions by content (the smallest hash of ``PREFIX`` words in it, the leftmost of
equals), so equal windows name the same words at the same place, and a run of neighbouring windows
shares one name. Names that occur in a single document cannot repeat and are dropped before any
text moves.

The stretches of text behind repeated names are partitioned by the name's words, a prefix that all
suffixes of a group share through it. Groups fit into memory: one whose stretches would not is
split by a longer prefix, the window itself, where a group is nothing but copies of one window and
its smallest document a minimum that needs no tree. For the others each task builds the tree of its
suffixes level by level (nodes of depth 1, 2, 4, ... words, by their pairs) down to the window's
depth. Internal nodes there are the repeats; the smallest document below a node keeps its words.

Whole copies of a text are settled first, by 128 bits of their word sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ROW, numbered, shuffle_partitions, sized, whole_ids, written
from lectern.llm.words import Words, chunks, find_words, sequence_hashes

WINDOW = 50
PREFIX = 8
# Stretches of one name that a task holds at once; more are split by the longer prefix.
GROUP_STRETCHES = 20_000
# Bytes of stretches whose trees are built together (always whole groups).
FOREST_BYTES = 2 << 20
# Stands for a null id: larger than any other, and never a smaller document.
LAST = 2**63 - 1


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    n, least = 1, x
    while n * 2 <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    count = len(x) - width + 1
    return np.minimum(least[:count], least[width - n : width - n + count])


def named_runs(grams: np.ndarray, n_words: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one text that name the same position: first and last window, the position."""
    place_bits = np.uint64(max(1, int(n_words).bit_length()))
    place = np.arange(len(grams), dtype=np.uint64)
    keys = (grams >> place_bits << place_bits) | place
    least = sliding_least(keys, window - PREFIX + 1)
    named = (least & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]]))
    return first, np.append(first[1:], len(named)) - 1, named[first]


def _texts(found: Words, window: int) -> Iterator[tuple[int, int, int]]:
    for i, (a, b) in enumerate(zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True)):
        if b - a >= window:
            yield i, a, b


def _sequences(window: int):
    """Fingerprints of whole word sequences: ``row, doc, n, high, low``; texts below a window left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            found = find_words(chunk.column("text"))
            kept, high, low, counts = [], [], [], []
            for i, a, b in _texts(found, window):
                print_ = hashlib.blake2b(found.hashes[a:b].tobytes(), digest_size=16).digest()
                kept.append(i)
                counts.append(b - a)
                high.append(int.from_bytes(print_[:8], "big", signed=True))
                low.append(int.from_bytes(print_[8:], "big", signed=True))
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [chunk.column("row").take(rows), chunk.column("doc").take(rows), *(pa.array(v, pa.int64()) for v in (counts, high, low))],
                names=["row", "doc", "n", "high", "low"],
            )

    return run


def _names(window: int):
    """All named runs: ``name, row, doc, first``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            found = find_words(chunk.column("text"))
            grams = sequence_hashes(found.hashes, PREFIX)
            names, owners, firsts = [], [], []
            for i, a, b in _texts(found, window):
                own = grams[a : b - PREFIX + 1]
                first, _, at = named_runs(own, b - a, window)
                names.append(own[at])
                owners.append(np.full(len(at), i))
                firsts.append(first)
            owner = pa.array(np.concatenate(owners) if owners else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((np.concatenate(names) if names else np.zeros(0, np.uint64)).view(np.int64)),
                    chunk.column("row").take(owner),
                    chunk.column("doc").take(owner),
                    pa.array((np.concatenate(firsts) if firsts else np.zeros(0)).astype(np.int32)),
                ],
                names=["name", "row", "doc", "first"],
            )

    return run


def _picked_runs(chunk: pa.RecordBatch, window: int) -> Iterator[tuple[int, Words, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of each text that its list ``firsts`` picks: text, words, first word, first and last windows, names."""
    found = find_words(chunk.column("text"))
    grams = sequence_hashes(found.hashes, PREFIX)
    for i, a, b in _texts(found, window):
        own = grams[a : b - PREFIX + 1]
        first, last, at = named_runs(own, b - a, window)
        picked = np.isin(first, chunk.column("firsts")[i].values.to_numpy(zero_copy_only=False))
        yield i, found, a, first[picked], last[picked], own[at[picked]]


def _stretches(window: int):
    """The text behind picked runs: ``name, row, doc, first, stretch``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            names, owners, firsts, texts = [], [], [], []
            for i, found, a, first, last, name in _picked_runs(chunk, window):
                begin, end = found.starts[a + first], found.ends[a + last + window - 1]
                texts += [found.data[s:e].tobytes() for s, e in zip(begin.tolist(), end.tolist(), strict=True)]
                names.append(name)
                owners.append(np.full(len(first), i))
                firsts.append(first)
            if not names:
                continue
            owner = pa.array(np.concatenate(owners))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(names).view(np.int64)),
                    chunk.column("row").take(owner),
                    chunk.column("doc").take(owner),
                    pa.array(np.concatenate(firsts).astype(np.int32)),
                    pa.array(texts, pa.binary()),
                ],
                names=["name", "row", "doc", "first", "stretch"],
            )

    return run


def _single_windows(window: int):
    """Windows of picked runs by 128 bits of their words: ``high, low, row, doc, first, known``.

    Within a chunk only the smallest document's windows still need the other chunks; of the rest it
    is already ``known`` that a smaller document has them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            docs = chunk.column("doc").to_numpy()
            highs, lows, owners, places = [], [], [], []
            for i, found, a, first, last, _ in _picked_runs(chunk, window):
                at = np.concatenate([np.arange(f, t + 1) for f, t in zip(first, last, strict=True)]) if len(first) else first
                words = found.hashes[a : int(found.bounds[i + 1])]
                highs.append(sequence_hashes(words, window, 21)[at])
                lows.append(sequence_hashes(words, window, 22)[at])
                owners.append(np.full(len(at), i))
                places.append(at)
            if not owners:
                continue
            high, low, owner, place = (np.concatenate(v) for v in (highs, lows, owners, places))
            order = np.lexsort((docs[owner], low, high))
            high, low, owner, place = high[order], low[order], owner[order], place[order]
            new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
            least = docs[owner][np.flatnonzero(new)][np.cumsum(new) - 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(high.view(np.int64)),
                    pa.array(low.view(np.int64)),
                    chunk.column("row").take(pa.array(owner)),
                    chunk.column("doc").take(pa.array(owner)),
                    pa.array(place.astype(np.int32)),
                    pa.array(least < docs[owner]),
                ],
                names=["high", "low", "row", "doc", "first", "known"],
            )

    return run


def deep_nodes(hashes: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that hold a whole window inside their stretch, and their node at the window's depth.

    A node of depth 2d is a pair of nodes of depth d, one d words after the other, so each level
    follows from the one above by sorting pairs; the last level overlaps if the depth is no power of two.
    """
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(hashes))
    at = np.arange(len(hashes))
    node = np.unique(hashes, return_inverse=True)[1].astype(np.uint64)
    depth = 1
    while depth < window:
        step = min(depth, window - depth)
        at = at[left[at] >= depth + step]
        pair = (node[at] << np.uint64(32)) | node[at + step]
        node = node.copy()
        node[at] = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        depth += step
    return at, node[at].astype(np.int64)


def _repeats(forest: pa.Table, window: int) -> pa.RecordBatch:
    """Runs of windows that a smaller document has too: ``row, first, last``."""
    found = find_words(pc.cast(forest.column("stretch").combine_chunks(), pa.string()))
    at, node = deep_nodes(found.hashes, found.bounds, window)
    owner = np.searchsorted(found.bounds, at, "right") - 1
    docs = forest.column("doc").to_numpy()[owner]
    least = np.full(int(node.max()) + 1 if len(node) else 0, LAST)
    np.minimum.at(least, node, docs)
    gone = least[node] < docs
    at, owner = at[gone], owner[gone]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])])) if len(at) else at
    last = np.append(first[1:], len(at)) - 1 if len(at) else at
    begin = forest.column("first").to_numpy()[owner] - found.bounds[owner] + at
    return pa.RecordBatch.from_arrays(
        [pa.array(forest.column("row").to_numpy()[owner[first]]), pa.array(begin[first]), pa.array(begin[last])],
        names=["row", "first", "last"],
    )


def _trees(window: int):
    """Builds the trees of whole groups (rows come sorted by name), about ``FOREST_BYTES`` at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, name = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("name").to_numpy()
            sizes = pc.binary_length(batch.column("stretch")).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]])).tolist()
            begin = 0
            for edge, end in zip(edges[:-1], edges[1:], strict=True):
                if size >= FOREST_BYTES and names[edge] != name:
                    held.append(batch.slice(begin, edge - begin))
                    yield _repeats(pa.Table.from_batches(held), window)
                    held, size, begin = [], 0, edge
                size, name = size + int(sizes[edge:end].sum()), names[edge]
            held.append(batch.slice(begin))
        if held:
            yield _repeats(pa.Table.from_batches(held), window)

    return run


def _kept(window: int):
    """``doc_id, n_words, n_removed, kept_sha256, row`` from texts, removed windows and whole copies."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            counts, gone, prints = [], [], []
            columns = (chunk.column(n).to_pylist() for n in ("text", "removed", "copy"))
            for text, removed, copy in zip(*columns, strict=True):
                words = (text or "").encode().split()
                kept = words
                if copy and len(words) >= window:
                    kept = []
                elif removed:
                    change = np.zeros(len(words) + 1, np.int64)
                    for run_ in removed:
                        change[run_["first"]] += 1
                        change[run_["last"] + window] -= 1
                    kept = [w for w, c in zip(words, np.cumsum(change).tolist(), strict=False) if not c]
                counts.append(len(words))
                gone.append(len(words) - len(kept))
                prints.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(prints),
                    chunk.column("row"),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "row"],
            )

    return run


def removed_windows(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", group_stretches: int = GROUP_STRETCHES
) -> tuple[DataFrame, DataFrame]:
    """Runs of windows (``row, first, last``) that a document with a smaller id has too, and whole copies (``row``).

    ``row`` is the row's number in the table. A row in the second table repeats all words of a
    document with a smaller id; its windows are not listed in the first.
    """
    if window < PREFIX:
        raise ValueError(f"windows have at least {PREFIX} words")
    docs = numbered(docs)
    texts = docs.select(
        F.col(ROW).alias("row"),
        F.coalesce(whole_ids(docs, id_col).cast("long"), F.lit(LAST)).alias("doc"),
        F.col(text_col).cast("string").alias("text"),
    )
    sequences = texts.mapInArrow(_sequences(window), "row long, doc long, n long, high long, low long")
    sequences = written(sequences, "sequences")
    least = sequences.groupBy("high", "low", "n").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most")
    copies = written(sequences.join(least, ["high", "low", "n"]).filter("doc > least").select("row"), "copies")
    single = texts.join(sized(copies, 16), "row", "left_anti")
    runs = written(single.mapInArrow(_names(window), "name long, row long, doc long, first int"), "names")
    repeated = written(
        runs.groupBy("name").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most").select("name", "n"),
        "repeated",
    )

    def picked(condition) -> DataFrame:
        names = written(repeated.filter(condition).select("name"), "prefixes")
        return written(runs.join(sized(names, 16), "name").groupBy("row").agg(F.collect_list("first").alias("firsts")), "picked")

    # Texts meet their lists by row: a shuffle of the texts at any size, so lists may grow with the input.
    small = single.join(picked(F.col("n") <= group_stretches), "row")
    stretches = small.mapInArrow(_stretches(window), "name long, row long, doc long, first int, stretch binary")
    parts = shuffle_partitions(docs.sparkSession)
    found = (
        stretches.repartition(parts, "name").sortWithinPartitions("name").mapInArrow(_trees(window), "row long, first long, last long")
    )
    if repeated.filter(F.col("n") > group_stretches).limit(1).count():
        large = single.join(picked(F.col("n") > group_stretches), "row")
        windows = written(
            large.mapInArrow(_single_windows(window), "high long, low long, row long, doc long, first int, known boolean"), "windows"
        )
        open_ = windows.filter(~F.col("known"))
        smallest = open_.groupBy("high", "low").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most")
        across = open_.join(smallest, ["high", "low"]).filter("doc > least").select("row", "first")
        singles = windows.filter("known").select("row", "first").union(across)
        found = found.union(singles.select("row", F.col("first").cast("long"), F.col("first").cast("long").alias("last")))
    return written(found, "removed"), copies


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256, row``.

    A word is removed if a window that covers it also begins in a document with a smaller id;
    windows are judged on the input. Null text has no words. A text with fewer words than a window
    keeps them all. Rows with the same id never remove each other's words; a null id is larger than
    all others; ids that are no whole numbers are refused. Other columns are not read.
    """
    docs = numbered(docs)
    runs, copies = removed_windows(docs, window, id_col, text_col, **options)
    lists = written(runs.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("removed")), "lists")
    texts = docs.select(F.col(ROW).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = texts.join(lists, "row", "left").join(sized(copies, 16).withColumn("copy", F.lit(True)), "row", "left")
    kind = dict(docs.dtypes)[id_col]
    return marked.mapInArrow(_kept(window), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, row long")
