"""Packing of token sequences, balanced by attention cost.

Documents are tokenised where they lie. Only pieces' numbers (never ids) are shuffled: by hash into
groups of bounded size, and each group assigns its pieces, longest first, to the sequence of lowest
cost that still has room. Cost is linear plus quadratic in a piece's tokens, since attention stays
within a document.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import text_or_empty, written
from lectern.llm.words import PUNCTUATION, SEPARATOR, chunks, hash_spans, text_bytes

CAPACITY = 4096
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
GROUP_PIECES = 4096
CACHED_UNITS = 1_000_000
APOSTROPHE = 39
PROBES = "a, b'll (c)d 'x don't. 3.14 <e> fg-hi !?j é,ü \"k\"' ''s l''m &'t"


class UnitTokenizer:
    """Token ids of whole texts, with the ids of each unit of text computed once.

    Units are what lies between ASCII blanks, cut again where an ASCII letter or digit meets ASCII
    punctuation (not after an apostrophe). A tokenizer that drops blanks and never joins across
    such places gives a text the ids of its units in order; this is probed, and any other tokenizer,
    and any text that holds one of its special tokens, is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()
        whole = self.tokenizer.encode(PROBES, add_special_tokens=False).ids
        parts = self._units(pa.array([PROBES]))
        data, starts, ends, _ = parts
        self.joins = whole != [i for s, e in zip(starts, ends, strict=True) for i in self._encode([data[s:e].tobytes().decode()])[0]]

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _units(column: pa.Array):
        data, offsets = text_bytes(column)
        blank = SEPARATOR[data]
        mark = PUNCTUATION[data]
        plain = ~mark & (data < 128)
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        cut[1:-1] |= blank[1:] != blank[:-1]
        cut[1:-1] |= plain[:-1] & mark[1:]
        cut[1:-1] |= mark[:-1] & (data[:-1] != APOSTROPHE) & plain[1:]
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        filled = ~blank[starts] if len(starts) else np.zeros(0, bool)
        starts, ends = starts[filled], ends[filled]
        return data, starts, ends, np.searchsorted(starts, offsets)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids = self._encode(texts)
        count = np.array([len(i) for i in ids], np.int64)
        flat = np.array([i for one in ids for i in one], np.uint32)
        if len(self.keys) + len(keys) > CACHED_UNITS:
            self.clear()
        keys = np.concatenate([self.keys, keys])
        first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        count = np.concatenate([self.count, count])
        order = np.argsort(keys, kind="stable")
        self.keys, self.first, self.count = keys[order], first[order], count[order]
        self.flat = np.concatenate([self.flat, flat])

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of the column."""
        if self.joins:
            for text in column.to_pylist():
                yield np.array(self._encode([text or ""])[0], np.uint32)
            return
        data, starts, ends, bounds = self._units(column)
        raw = data.tobytes()
        keys, at, back = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != keys[inside]
        if len(self.keys) + int(new.sum()) > CACHED_UNITS:
            self.clear()
            new[:] = True
        if new.any():
            spans = zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)
            self._learn(keys[new], [raw[s:e].decode() for s, e in spans])
        place = np.searchsorted(self.keys, keys)
        first, count = self.first[place][back], self.count[place][back]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.arange(total[-1]) - np.repeat(total[:-1], count) + np.repeat(first, count)]
        special = any(s in raw for s in self.special)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if special and any(s in (column[i].as_py() or "").encode() for s in self.special):
                yield np.array(self._encode([column[i].as_py()])[0], np.uint32)
            else:
                yield ids[total[a] : total[b]]


_loaded: dict[str, UnitTokenizer] = {}


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = UnitTokenizer(path)
        encode = _loaded[path]
        for chunk in chunks(batches, "text", 4 << 20):
            owner, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(encode(chunk.column("text"))):
                ids = np.append(ids, end_id).astype("<u4")
                for a in range(0, len(ids), capacity):
                    part = ids[a : a + capacity]
                    owner.append(i)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
            rows = pa.array(owner, pa.int64())
            numbers = [pa.array(v, pa.int64()) for v in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id").take(rows), chunk.column("row").take(rows), *numbers],
                names=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


def tokenised_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of at most ``capacity``: where, how long, checksum."""
    kind = dict(docs.dtypes)[id_col]
    return docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_or_empty(text_col).alias("text")
    ).mapInArrow(
        _pieces(tokenizer, capacity, end_id),
        f"doc_id {kind}, row long, start long, length long, ids_crc32 long, doc_tokens long",
    )


def assign(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece, for lengths in descending order.

    As many sequences as the tokens need are open from the start; a piece goes to the one of lowest
    cost with room for it, and opens another when there is none.
    """
    n = -(-int(lengths.sum()) // capacity)
    room = np.full(n + len(lengths), capacity, np.int64)
    cost = np.zeros(n + len(lengths))
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        fits = np.flatnonzero(room[:n] >= length)
        if len(fits):
            s = fits[cost[fits].argmin()]
        else:
            s, n = n, n + 1
        sequence[i], offset[i] = s, capacity - room[s]
        room[s] -= length
        cost[s] += LINEAR * length + QUADRATIC * length * length
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and the end id; longer ones are cut at multiples of ``capacity``. Null
    and empty texts are the end id alone. Pieces of a sequence follow each other without a gap.
    Pieces are grouped by a hash over id, place and row, so repeated rows spread too; groups hold
    about ``GROUP_PIECES`` pieces whatever the size of the table. Other columns are not read.
    """
    pieces = written(tokenised_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    groups = max(1, pieces.count() // GROUP_PIECES)

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row", "start"], ascending=[False, True, True], kind="stable")
        sequence, offset = assign(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=(group["bin"].to_numpy().astype(np.int64) << 32) + sequence, offset=offset).drop(columns="bin")

    kind = dict(docs.dtypes)[id_col]
    return (
        pieces.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(groups)))
        .groupBy("bin")
        .applyInPandas(
            fill,
            f"doc_id {kind}, row long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
        )
        .drop("row")
    )
