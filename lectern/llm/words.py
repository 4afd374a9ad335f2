"""Words and their 64-bit hashes for whole batches of texts at once.

Words are ``[^\\x20\\x09-\\x0D]+``. All separators are ASCII, so words are found in the UTF-8 bytes of
an Arrow column without decoding a single row. A word's hash sums one random number per (position,
byte) and mixes the sum; two given words collide with a chance of about 2^-64. Words above 64 bytes
are hashed by xxHash.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
# Every ASCII character but letters and digits.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[128:] = False
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    PUNCTUATION[_low:_high] = False
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32
# A power of two.
LONG = 64
# Bytes hashed at once: bounds the index arrays, which take eight bytes for each of these.
BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit moves about half of the output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers that look random."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([seed], np.uint64)))


TABLE = numbers(LONG * 256, 1)


class Words(NamedTuple):
    """Words of a batch: their byte spans in ``data``, hashes, and where each text's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i + 1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets between them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of non-empty byte spans that do not overlap and lie in order, about ``BLOCK`` bytes at a time."""
    lengths = ends - starts
    hashes = np.empty(len(starts), np.uint64)
    done = np.concatenate([[0], np.cumsum(lengths)])
    low = 0
    while low < len(starts):
        high = min(len(starts), max(low + 1, int(np.searchsorted(done, done[low] + BLOCK))))
        own = lengths[low:high]
        firsts = done[low:high] - done[low]
        inside = np.arange(int(own.sum()), dtype=np.int64)
        at = inside + np.repeat(starts[low:high] - firsts, own)
        inside -= np.repeat(firsts, own)
        inside &= LONG - 1
        inside <<= 8
        inside += data[at]
        hashes[low:high] = mix(np.add.reduceat(TABLE[inside], firsts) + own.astype(np.uint64))
        low = high
    for i in np.flatnonzero(lengths > LONG):
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return hashes


def find_words(column: pa.Array, lower: bool = False, separator: np.ndarray = SEPARATOR) -> Words:
    """Words of all texts; ``lower`` lower-cases A-Z first, ``separator`` says which bytes part words."""
    raw, offsets = text_bytes(column)
    data = np.frombuffer(raw.tobytes().translate(LOWER.tobytes()), np.uint8) if lower else raw
    inside = ~separator[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    first = np.ones(len(data), bool)
    first[1:] = ~inside[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & first)
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:]
    cut = offsets[1:] - 1
    last[cut[cut >= 0]] = True
    ends = np.flatnonzero(inside & last) + 1
    return Words(data, starts, ends, hash_spans(data, starts, ends), np.searchsorted(starts, offsets))


def sequence_hashes(hashes: np.ndarray, size: int, seed: int = 2) -> np.ndarray:
    """Hash of every ``size`` consecutive words (also across texts: the caller picks valid ones)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = numbers(size, seed) | np.uint64(1)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += hashes[j : j + n] * factors[j]
    return mix(total + np.uint64(size))


def release() -> None:
    """Gives freed memory back, so that a reused Python worker does not keep the peak of its last task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def chunks(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most ``most_bytes`` of text (a longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(size)
        yield batch.slice(begin)
        del batch
        release()


def gathered(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of consecutive small batches together, up to ``most_bytes`` of text (a longer text is a slice of its own)."""
    held, size = [], 0
    for part in chunks(batches, column, most_bytes):
        own = part.column(column).nbytes
        if held and size + own > most_bytes:
            yield _joined(held)
            held, size = [], 0
        held.append(part)
        size += own
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
