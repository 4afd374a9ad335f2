"""Near duplicates by SimHash, found through the numbers of bits set in segments of a fingerprint.

The 64 bits of a fingerprint are cut into 32 segments, and the numbers of bits set in them (0 to 2) are
a point in a grid of 32 dimensions. One flipped bit moves the point by one step in one dimension, so the Manhattan
distance of two points never exceeds the Hamming distance of their fingerprints. Every distinct fingerprint
is put into its own cell and all cells one step away; two points within two steps share a cell. Who meets in a cell
is then compared exactly. A cell's counts take two bits each, so a cell is one 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written
from lectern.llm.components import components
from lectern.llm.words import LOWER, SEPARATOR, chunks, text_bytes

SHINGLE, SEED, BITS = 3, 42, 64
RADIUS = 2
# Bytes of text and shingles taken at once.
TEXT_BLOCK, SHINGLE_BLOCK = 1 << 20, 1 << 16
EVEN_BITS = 0x5555555555555555


def _spaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with one blank behind each word, and the words' starts and ends in them."""
    data = LOWER[data]
    blank = SEPARATOR[data]
    behind = blank.copy()
    behind[1:] &= ~blank[:-1]
    behind[:1] = False
    packed = data[~blank | behind]
    packed[SEPARATOR[packed]] = 32
    gaps = np.flatnonzero(packed == 32)
    if len(packed) and packed[-1] != 32:
        gaps = np.append(gaps, len(packed))
    return packed, np.concatenate([[0], gaps[:-1] + 1]).astype(np.int64)[: len(gaps)], gaps


def _bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _count(data: np.ndarray, counts: np.ndarray, words: int) -> int:
    """Adds the bits of all shingles of ``words`` words in ``data`` to ``counts`` and returns their number."""
    packed, starts, ends = _spaced(data)
    raw = memoryview(packed.tobytes())
    n = max(0, len(starts) - words + 1)
    for low in range(0, n, SHINGLE_BLOCK):
        high = min(n, low + SHINGLE_BLOCK)
        spans = zip(starts[low:high].tolist(), ends[low + words - 1 : high + words - 1].tolist(), strict=True)
        digest = xxhash.xxh64_intdigest
        counts += _bits_set(np.array([digest(raw[a:b], SEED) for a, b in spans], np.uint64))
    return n


def _parts(data: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """A text in parts cut behind a separator; each part begins with the last words of the one before."""
    if len(data) <= TEXT_BLOCK:
        yield data
        return
    carried, begin = data[:0], 0
    while begin < len(data):
        cut = begin + TEXT_BLOCK
        while cut < len(data):
            blanks = np.flatnonzero(SEPARATOR[data[cut : cut + TEXT_BLOCK]])
            if len(blanks):
                cut += int(blanks[0]) + 1
                break
            cut += TEXT_BLOCK
        part = np.concatenate([carried, data[begin:cut]])
        yield part
        packed, starts, _ = _spaced(part)
        tail = packed[starts[max(0, len(starts) - words + 1)] :] if len(starts) and words > 1 else packed[:0]
        carried = np.append(tail, np.uint8(32)) if len(tail) else tail
        begin = cut


def fingerprint(data: np.ndarray, words: int = SHINGLE) -> int:
    """SimHash of one text given as UTF-8 bytes: a bit is set if more than half the shingles' hashes set it."""
    counts, total = np.zeros(BITS, np.int64), 0
    for part in _parts(data, words):
        total += _count(part, counts, words)
    if not total:
        packed, starts, ends = _spaced(data)
        if not len(starts):
            return 0
        return xxhash.xxh64_intdigest(packed[: ends[-1]].tobytes(), SEED)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def _fingerprints(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            data, offsets = text_bytes(chunk.column("text"))
            found = np.array([fingerprint(data[a:b], words) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "bits"])

    return run


def fingerprints(docs: DataFrame, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, bits`` (the fingerprint as a signed number) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _fingerprints(words), f"doc_id {kind}, bits long"
    )


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def cells(marks: DataFrame) -> DataFrame:
    """``cell, bits``: the grid cell of each fingerprint and all cells one step away.

    The counts 0, 1, 2 of a segment are its bits 00, 01, 10; a step between 0 and 1 flips the lower bit, one
    between 1 and 2 flips both. No arithmetic is needed, so nothing can overflow.
    """
    odd = F.call_function("shiftrightunsigned", F.col("bits"), F.lit(1)).bitwiseAND(F.lit(EVEN_BITS))
    even = F.col("bits").bitwiseAND(F.lit(EVEN_BITS))
    own = even.bitwiseXOR(odd).bitwiseOR(F.call_function("shiftleft", even.bitwiseAND(odd), F.lit(1)))
    steps = [(0, 0, 0)]
    for segment in range(BITS // 2):
        one, two = 1 << 2 * segment, 2 << 2 * segment
        # (what to flip, the bits that decide whether the step exists, whether they have to be zero or not)
        steps += [(one, two, 0), (one | two, one | two, 1)]
    moves = F.array(
        *[F.struct(F.lit(_signed(f)).cast("long").alias("flip"), F.lit(_signed(t)).cast("long").alias("test"), F.lit(s).alias("some")) for f, t, s in steps]
    )
    tested = (F.col("own").bitwiseAND(F.col("test")) != 0) == (F.col("some") == 1)
    return (
        marks.select("bits", own.alias("own"))
        .select("bits", "own", F.inline(moves))
        .filter(tested)
        .select(F.col("own").bitwiseXOR(F.col("flip")).alias("cell"), "bits")
    )


def links(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints (column ``bits``) that differ in at most ``radius`` bits.

    A fingerprint has at most 2,080 others within two bits, so pairs do not grow with the square of a group.
    """
    if radius > 2:
        raise ValueError("cells one step away serve a radius of 2 at most")
    # Spark takes an exploded table for as large as the one below it, so it would broadcast some fifty rows for each one counted.
    placed = cells(marks).hint("merge")
    left, right = placed.withColumnRenamed("bits", "a"), placed.withColumnRenamed("bits", "b")
    differing = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return left.join(right, "cell").filter((F.col("a") < F.col("b")) & (differing <= radius)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id, bits``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, shingles keep their repeats, a text with fewer words is one
    shingle, and null, empty and blank texts have fingerprint zero, which links like any other. The
    component is the smallest id (null only if all are null) among rows whose fingerprints are linked through others. Rows with
    equal fingerprints meet once, so copies and repeated rows cost no pairs. Texts of any length are read
    in parts of about ``TEXT_BLOCK`` bytes. An empty table gives no rows. Other columns are not read.
    """
    rows = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    marks = written(rows.groupBy("bits").agg(F.min("doc_id").alias("least")), "marks")
    roots = components(links(marks, radius)).withColumnRenamed("node", "bits")
    rooted = written(marks.join(roots, "bits", "left").select("bits", "least", F.coalesce("component", "bits").alias("root")), "roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(smallest, "root").select("bits", "component_id")
    return rows.join(classes, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "bits")
