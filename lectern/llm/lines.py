"""Line deduplication by overlapping windows of three lines.

Each window of consecutive lines gets a 128-bit hash. The first place of a hash, by id and position,
keeps its lines; every later place gives up the lines it covers, and the covered positions of a
document are merged. Windows overlap, so a repeated passage goes as a whole, while a single line that
happens to recur stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BROADCAST_BYTES, ROW, numbered, whole_ids, written
from lectern.llm.words import chunks, hash_spans, sequence_hashes, text_bytes

LINES = 3
# Stands for a null id: later than any other.
LAST = 2**63 - 1


def line_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, spans of their lines without the line break, and where each text's lines begin.

    An empty text has no lines; a line break at the end does not begin another line.
    """
    data, offsets = text_bytes(column)
    last = np.zeros(len(data), bool)
    last[data == 10] = True
    filled = offsets[1:][offsets[1:] > offsets[:-1]]
    last[filled - 1] = True
    ends = np.flatnonzero(last) + 1
    bounds = np.searchsorted(ends, offsets, "right")
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return data, starts, ends, bounds


def line_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each line without its line break; lines of the same characters are equal."""
    ends = ends - (data[ends - 1] == 10) if len(ends) else ends
    hashes = np.full(len(starts), 0x9E3779B97F4A7C15, np.uint64)
    short = np.flatnonzero((ends > starts) & (ends - starts <= 64))
    hashes[short] = hash_spans(data, starts[short], ends[short])
    for i in np.flatnonzero(ends - starts > 64).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return hashes


def _windows(lines: int):
    """Windows of a chunk: ``high, low, doc, row, line, known``.

    Of equal windows of a chunk only the first can be the first of all, so for the others it is
    ``known`` here that they come later.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            data, starts, ends, bounds = line_spans(chunk.column("text"))
            hashes = line_hashes(data, starts, ends)
            high, low = sequence_hashes(hashes, lines, 31), sequence_hashes(hashes, lines, 32)
            owner = np.searchsorted(bounds, np.arange(len(high)), "right") - 1
            inside = np.arange(len(high)) + lines <= bounds[owner + 1]
            high, low, owner, line = high[inside], low[inside], owner[inside], (np.arange(len(high)) - bounds[owner])[inside]
            docs, rows = chunk.column("doc").to_numpy()[owner], chunk.column("row").to_numpy()[owner]
            order = np.lexsort((line, rows, docs, low, high))
            new = np.ones(len(order), bool)
            new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(high[order].view(np.int64)),
                    pa.array(low[order].view(np.int64)),
                    pa.array(docs[order]),
                    pa.array(rows[order]),
                    pa.array(line[order].astype(np.int32)),
                    pa.array(~new),
                ],
                names=["high", "low", "doc", "row", "line", "known"],
            )

    return run


def _kept(lines: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            data, starts, ends, bounds = line_spans(chunk.column("text"))
            texts, gone = [], []
            for i, later in enumerate(chunk.column("later").to_pylist()):
                a, b = int(bounds[i]), int(bounds[i + 1])
                covered = np.zeros(b - a, bool)
                for line in later or ():
                    covered[line : line + lines] = True
                spans = zip(starts[a:b][~covered].tolist(), ends[a:b][~covered].tolist(), strict=True)
                texts.append(b"".join(data[s:e].tobytes() for s, e in spans).decode() if later else chunk.column("text")[i].as_py() or "")
                gone.append(int(covered.sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("doc_id"),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array(gone, pa.int64()),
                    pa.array(texts, pa.string()),
                    chunk.column("row"),
                ],
                names=["doc_id", "n_lines", "n_removed", "text", "row"],
            )

    return run


def later_windows(texts: DataFrame, lines: int = LINES) -> DataFrame:
    """``row, line`` of windows that are not the first of their kind; ``texts`` has ``row, doc, text``."""
    found = written(
        texts.mapInArrow(_windows(lines), "high long, low long, doc long, row long, line int, known boolean"), "line-windows"
    )
    place = F.struct("doc", "row", "line")
    first = found.filter(~F.col("known")).groupBy("high", "low").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    across = found.filter(~F.col("known")).join(first, ["high", "low"]).filter(place != F.col("first"))
    return found.filter("known").select("row", "line").union(across.select("row", "line"))


def remove_repeated_lines(docs: DataFrame, lines: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_removed, text, row``, the text without its removed lines.

    Windows are compared over all documents as they were given, first by id (null last), then by
    row of the table, then by position, within a document too. Kept lines keep their line breaks. Null
    text counts as empty and has no lines; a text with fewer lines than a window keeps them all;
    of repeated rows the first keeps its lines. Ids that are no whole numbers are refused. Other columns are not read.
    """
    docs = numbered(docs)
    texts = docs.select(
        F.col(ROW).alias("row"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(whole_ids(docs, id_col).cast("long"), F.lit(LAST)).alias("doc"),
        F.col(text_col).cast("string").alias("text"),
    )
    later = written(later_windows(texts.select("row", "doc", "text"), lines).groupBy("row").agg(F.collect_list("line").alias("later")), "later")
    held = later.agg(F.sum(F.size("later") * 4 + 32)).first()[0] or 0
    marked = texts.join(F.broadcast(later) if held <= BROADCAST_BYTES else later, "row", "left")
    kind = dict(docs.dtypes)[id_col]
    return marked.select("row", "doc_id", "text", "later").mapInArrow(
        _kept(lines), f"doc_id {kind}, n_lines long, n_removed long, text string, row long"
    )
