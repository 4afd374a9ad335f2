"""Arrow functions for the few steps Spark has no expression for."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import fixed


# Python functions become UDFs where they are used: a UDF kept by the module would hold the driver's connection to the JVM
# once it ran, and functions of this module could no longer be shipped.
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC form. Only rows with non-ASCII characters travel to Python."""
    foreign = F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), text)
    return F.coalesce(F.pandas_udf(_nfkc, T.StringType())(foreign), text)


ARROW_KEYWORDS = pa.list_(pa.struct([("word", pa.string()), ("count", pa.int64())]))
KEYWORDS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("count", T.LongType())]))


def keyword_counter(k: int, stop_words: tuple[str, ...], min_length: int):
    """Top-k words of each token list by count, ties by first occurrence; no token leaves its row.

    Works on whole Arrow batches: words are encoded once per batch, and counts and first places
    come from one sort of (row, word).
    """

    @F.arrow_udf(KEYWORDS)
    def count(tokens: pa.Array) -> pa.Array:
        lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        words = tokens.flatten().dictionary_encode()
        vocabulary = words.dictionary
        if not len(vocabulary):
            return pa.array([[] if v else None for v in tokens.is_valid().to_pylist()], ARROW_KEYWORDS)
        asked = pc.and_(
            pc.greater_equal(pc.utf8_length(vocabulary), min_length),
            pc.invert(pc.is_in(vocabulary, value_set=pa.array(stop_words, pa.string()))),
        ).to_numpy(zero_copy_only=False)
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(len(tokens)), lengths)
        kept = np.flatnonzero(asked[codes])
        cells, first, n = np.unique(rows[kept] * len(vocabulary) + codes[kept], return_index=True, return_counts=True)
        order = np.lexsort((first, -n, cells // len(vocabulary)))
        row = cells[order] // len(vocabulary)
        top = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
        entries = pa.StructArray.from_arrays(
            [vocabulary.take(pa.array(cells[top] % len(vocabulary))).cast(pa.string()), pa.array(n[top])], ["word", "count"]
        )
        bounds = np.searchsorted(cells[top] // len(vocabulary), np.arange(len(tokens) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), entries, mask=tokens.is_null())

    return count


# What a text must hold for any default pattern to match; the test runs in the JVM, and only texts
# that pass it travel to Python. Digits and blanks are those of any script (unassigned characters may be
# digits to Python); word boundaries, on
# which Java and Python differ, are not asked for.
# Most characters are small letters and blanks, at which none begins: one test each tells.
_ENTITY_GUARD = r"(?![\x00-/:-?\[-\x7F])(?:[\p{Nd}\p{Cn}]|@|LLC|Inc|Ltd|Corp|SA|GmbH|[A-Z][A-Za-z]+[\s\x1C-\x1F\x85\p{Z}]+[A-Z])"
# What a text must hold for a default pattern that tries every run of capitalised words to its end.
_NEEDED = {"company_suffix": re.compile("LLC|Inc|Ltd|Corp|SA|GmbH")}
# Stands between the texts of a batch. No pattern asks for it, and to word boundaries and
# lookbehinds it is like the end of a text.
_BETWEEN = "\x00"

ENTITIES = T.ArrayType(
    T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("subtype", T.StringType()),
            T.StructField("value", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )
)
ARROW_ENTITIES = pa.list_(
    pa.struct([("type", pa.string()), ("subtype", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
)


class _Batch:
    """Texts of a batch in one string, so that a pattern searches all of them in one run."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.joined = _BETWEEN.join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.ends = self.starts + sizes
        self.odd = {i for i, t in enumerate(texts) if _BETWEEN in t}

    def search(self, pattern: re.Pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of all matches, each text searched as if it stood alone.

        Texts into which a match reaches over from another one are searched once more, alone.
        """
        spans = np.array([m.span() for m in pattern.finditer(self.joined)], np.int64).reshape(-1, 2)
        row = np.searchsorted(self.starts, spans[:, 0], "right") - 1
        over = spans[:, 1] > self.ends[row]
        again = set(self.odd)
        for first, end in zip(row[over].tolist(), spans[over, 1].tolist(), strict=True):
            again.update(range(first, int(np.searchsorted(self.starts, end, "right"))))
        alone = [(i, *m.span()) for i in sorted(again) for m in pattern.finditer(self.texts[i])]
        keep = ~np.isin(row, list(again))
        inside = np.column_stack([row[keep], spans[keep] - self.starts[row[keep], None]])
        return tuple(np.concatenate([inside, np.array(alone, np.int64).reshape(-1, 3)]).T)


def _search_where(batch: _Batch, pattern: re.Pattern, needed: re.Pattern | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches in the texts that hold what the pattern needs."""
    if needed is None:
        return batch.search(pattern)
    rows = [i for i, text in enumerate(batch.texts) if needed.search(text)]
    row, start, end = _Batch([batch.texts[i] for i in rows]).search(pattern)
    return np.array(rows, np.int64)[row], start, end


def entity_finder(rules: str | dict = "default"):
    """Matches per type with offsets, sorted by start; a match inside an earlier one is dropped.

    Returns a function from a text column to an array column; blank texts have no entities, null
    texts a null.
    """
    compiled = {kind: [(re.compile(p, flags), sub) for p, sub, flags in patterns] for kind, patterns in _entity_rules(rules).items()}
    needed = _NEEDED if rules == "default" else {}

    @F.arrow_udf(ENTITIES)
    def entities(texts: pa.Array) -> pa.Array:
        batch = _Batch([t or "" for t in texts.to_pylist()])
        found: list[list[dict]] = [[] for _ in batch.texts]
        for kind, patterns in compiled.items() if batch.texts else ():
            parts = [(*_search_where(batch, p, needed.get(sub)), np.full(1, i)) for i, (p, sub) in enumerate(patterns)]
            row, start, end = (np.concatenate([part[c] for part in parts]) for c in range(3))
            place = np.concatenate([np.repeat(part[3], len(part[0])) for part in parts])
            last = (-1, -1)
            for i in np.lexsort((place, start, row)).tolist():  # pattern order decides equal starts
                at = (int(row[i]), int(start[i]))
                if at[0] != last[0] or at[1] >= last[1]:
                    last = (at[0], int(end[i]))
                    value = batch.texts[at[0]][at[1] : last[1]]
                    found[at[0]].append({"type": kind, "subtype": patterns[place[i]][1], "value": value, "start": at[1], "end": last[1]})
        return pa.array([f if v else None for f, v in zip(found, texts.is_valid().to_pylist(), strict=True)], ARROW_ENTITIES)

    def find(text: Column) -> Column:
        if rules != "default":
            return entities(text)
        none = F.when(text.isNotNull(), F.array().cast(ENTITIES))
        return F.coalesce(entities(F.when(F.rlike(text, F.lit(_ENTITY_GUARD)), text)), none)

    return find


def _entity_rules(rules: str | dict) -> dict:
    if isinstance(rules, dict):
        return {k: [(p, s, re.IGNORECASE) for p, s in v] for k, v in rules.items()}
    table = fixed.ENTITY_PATTERNS_REFERENCE
    if rules == "reference":
        return {k: [(p, s, re.IGNORECASE) for p, s in v] for k, v in table.items()}
    if rules != "default":
        raise ValueError(f"unknown entity rules {rules!r}")
    return {
        kind: [
            (fixed.ENTITY_CORRECTIONS.get(s, p), s, 0 if kind in fixed.CASE_SENSITIVE_ENTITY_TYPES else re.IGNORECASE)
            for p, s in patterns
        ]
        for kind, patterns in table.items()
    }


def split_proposer(load, window: int = 20, step: int = 10):
    """Split points of a document's pieces, proposed window by window by a loaded function.

    ``load`` runs once per batch of rows and returns pieces -> split points relative to the
    window. A call without points splits half-way, a failing call after ``step`` pieces; the
    next window starts at the last split. The last ``step`` pieces are not asked about, all
    others are, however many there are; a window that proposes only its own start ends the search.
    """

    def points(ask, part: list[str]) -> set[int]:
        """Proposed points of one window, 0 included if it was proposed."""
        try:
            asked = {int(s) for s in ask(part)}
        except Exception:
            return {step}
        return {s for s in asked if s >= 0} or {len(part) // 2}

    def propose(ask, pieces: list[str]) -> list[int]:
        cuts, at, moved = {0}, 0, True
        while moved and len(pieces) - at > step:
            found = points(ask, pieces[at : at + window])
            cuts |= {at + s for s in found if s}
            at, moved = at + max(found), max(found) > 0
        return sorted(cuts)

    # Pieces become Python strings one row at a time, not a whole Arrow batch of them.
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def splits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ask = load()
        for rows in batches:
            yield pa.array([propose(ask, pieces.as_py()) if pieces.is_valid else None for pieces in rows], pa.list_(pa.int32()))

    return splits


SUBWORD_WINDOWS = T.ArrayType(
    T.StructType(
        [
            T.StructField("chunk", T.StringType()),
            T.StructField("start_char", T.IntegerType()),
            T.StructField("end_char", T.IntegerType()),
            T.StructField("n_tokens", T.IntegerType()),
        ]
    )
)


def window_bounds(offsets: np.ndarray, max_tokens: int, step: int) -> list[tuple[int, int]]:
    """(first token, token behind the last) of windows that begin ``step`` tokens apart.

    A window never begins or ends inside a character: such a bound moves back to the character's first token,
    and on to the next character only where going back would not get on.
    """
    n = len(offsets)
    if n == 0:
        return []
    whole = np.ones(n + 1, dtype=bool)
    whole[1:n] = offsets[1:, 0] >= np.maximum.accumulate(offsets[:-1, 1])
    marks = np.flatnonzero(whole)
    back = np.maximum.accumulate(np.where(whole, np.arange(n + 1), 0))

    def bound(at: int, beyond: int) -> int:
        found = int(back[min(at, n)])
        return found if found > beyond else int(marks[np.searchsorted(marks, beyond, side="right")])

    found, first = [], 0
    while first < n:
        found.append((first, bound(first + max_tokens, first)))
        first = bound(first + step, first)
    return found


_BLANK = re.compile(r"[ \t\n\v\f\r]")
# Words whose offsets a Python worker keeps.
CACHED_WORDS = 1 << 20
_PROBES = "a, b'll (c)d 'x don't. 3.14 <e> fg-hi\t!?j é,ü \"k\"'\n\n's  l''m &'t"


class WordOffsets:
    """Character offsets of a text's tokens, with those of each word between ASCII blanks computed once.

    A tokenizer that drops blanks and never joins across them gives a text the tokens of its words in order; this is
    probed, and any other tokenizer, and any text that holds one of its special tokens, is encoded as a whole.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.clear()
        self.whole = False
        self.whole = not np.array_equal(self(_PROBES), self._encode(_PROBES))

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.count, self.flat = array("q"), array("q"), array("q")

    def _encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)

    def __call__(self, text: str) -> np.ndarray:
        if self.whole or any(s in text for s in self.special):
            return self._encode(text)
        words = _BLANK.split(text)
        if len(self.known) > CACHED_WORDS:
            self.clear()
        self._learn([w for w in set(words) if w not in self.known])
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        first, count = np.frombuffer(self.first, np.int64)[at], np.frombuffer(self.count, np.int64)[at]
        behind = np.cumsum(count)
        tokens = np.arange(behind[-1]) + np.repeat(first - behind + count, count)
        own = np.frombuffer(self.flat, np.int64).reshape(-1, 2)[tokens] if len(tokens) else np.zeros((0, 2), np.int64)
        return own + np.repeat(_begins(words), count)[:, None]

    def _learn(self, words: list[str]) -> None:
        """Offsets of new words, from one run over all of them."""
        if not words:
            return
        offsets, begins = self._encode(" ".join(words)), _begins(words)
        edges = np.searchsorted(offsets[:, 0], begins)
        count = np.diff(np.append(edges, len(offsets)))
        self.known.update(zip(words, range(len(self.first), len(self.first) + len(words)), strict=True))
        self.first.frombytes((len(self.flat) // 2 + edges).astype(np.int64).tobytes())
        self.count.frombytes(count.astype(np.int64).tobytes())
        self.flat.frombytes((offsets - np.repeat(begins, count)[:, None]).tobytes())


def _begins(words: list[str]) -> np.ndarray:
    """Where words with one blank between them begin."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.cumsum(sizes + 1) - sizes - 1


def subword_windows(load, max_tokens: int, step: int):
    """Windows of a loaded tokenizer's tokens, cut from the text itself at the tokens' character offsets."""

    @F.pandas_udf(SUBWORD_WINDOWS)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        offsets_of = load()

        def windows(text: str | None) -> list | None:
            if not text:
                return None
            offsets = np.asarray(offsets_of(text), dtype=np.int64).reshape(-1, 2)
            starts = np.append(offsets[:, 0], len(text))
            starts[0] = 0
            return [
                {"chunk": text[i:j], "start_char": i, "end_char": j, "n_tokens": b - a}
                for a, b in window_bounds(offsets, max_tokens, step)
                for i, j in [(int(starts[a]), int(starts[b]))]
            ]

        for texts in batches:
            yield texts.map(windows)

    return cut


def tokenizer_functions(load):
    """(encode, decode) between text and token ids for a loaded tokenizer, batch by batch.

    ``load`` runs once per Python worker and returns an object with ``encode`` (texts ->
    id lists) and ``decode`` (id lists -> texts).
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load()
        for texts in batches:
            yield pd.Series(list(tokenizer.encode(texts.fillna("").tolist())), dtype=object)

    @F.pandas_udf(T.StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load()
        for ids in batches:
            yield pd.Series(list(tokenizer.decode([list(i) for i in ids])), dtype=object)

    return encode, decode


# Entities that stay escaped until markup has been read.
_MARKUP_ENTITY = re.compile(r"&(?:amp|lt|gt|quot|apos|#39|#34|#38|#60|#62|#x0*(?:22|26|27|3c|3e));?", re.IGNORECASE)
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
# Entities beyond those that expressions decode.
_RARE_ENTITY = r"&(?!(?:amp|lt|gt|quot|apos|nbsp|#39);)(?:#|[A-Za-z])[A-Za-z0-9]*;"


def _decode(text: str) -> str:
    def one(match: re.Match) -> str:
        entity = match.group(0)
        return entity if _MARKUP_ENTITY.fullmatch(entity) else html.unescape(entity)

    return _ENTITY.sub(one, text)


def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else _decode(t))


def unescape_entities(text: Column) -> Column:
    """Named and numeric entities as characters, except those that would become markup.

    Only texts with an entity travel to Python.
    """
    escaped = F.when(F.rlike(text, F.lit(r"&(?:#|[A-Za-z])[A-Za-z0-9]*;")), text)
    return F.coalesce(F.pandas_udf(_unescape, T.StringType())(escaped), text)


_TABLE_TAG = re.compile(r"<(/?)table\b[^>]*>", re.IGNORECASE)


def _unnested(text: str) -> str:
    """Nested tables moved behind their outer table, with their text left in the cell.

    An outer table then reads like any other, and an inner one is a table of its own. Text whose
    table tags do not pair up stays as it is.
    """
    stack: list[dict] = [{"parts": [], "inner": []}]
    at = 0
    for tag in _TABLE_TAG.finditer(text):
        stack[-1]["parts"].append(text[at : tag.start()])
        at = tag.end()
        if not tag[1]:
            stack.append({"parts": [tag[0]], "inner": []})
            continue
        if len(stack) == 1:
            return text
        table = stack.pop()
        table["parts"].append(tag[0])
        whole = "".join(table["parts"])
        if len(stack) > 1:
            stack[-1]["parts"].append(" ".join(re.sub(r"(?s)<[^>]*>", " ", whole).split()))
            stack[-1]["inner"] += [whole, *table["inner"]]
        else:
            stack[-1]["parts"] += [whole, *("\n\n" + inner for inner in table["inner"])]
    return text if len(stack) > 1 else "".join([*stack[0]["parts"], text[at:]])


def _readable(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else _decode(_unnested(t)))


def readable_markup(text: Column) -> Column:
    """Text that the markup expressions can read: no nested tables, no entities beyond the common ones.

    The control characters that these expressions use as marks (U+0001 to U+0005) become U+FFFD, one
    for one. Only texts with two tables or a rarer entity travel to Python.
    """
    odd = F.rlike(text, F.lit(_RARE_ENTITY)) | (F.regexp_count(text, F.lit(r"(?i)<table\b")) > 1)
    free = F.when(F.rlike(text, F.lit(r"[\x01-\x05]")), F.translate(text, "\x01\x02\x03\x04\x05", "\ufffd" * 5)).otherwise(text)
    return F.coalesce(F.pandas_udf(_readable, T.StringType())(F.when(odd, free)), free)


def token_slot(token: str, dim: int) -> int:
    """Vector slot of a token: the first eight hex digits of its MD5, modulo the dimension."""
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % dim


# Bytes of a batch that are worked on at once: they bound the arrays that a step makes of them.
PART_BYTES = 4 << 20


def bounded(batch: pa.Array | pa.RecordBatch, most: int | None = None) -> Iterator[pa.Array | pa.RecordBatch]:
    """Neighbouring rows of a batch, about ``most`` bytes at once; a larger row comes alone."""
    rows = len(batch) if isinstance(batch, pa.Array) else batch.num_rows
    step = max(1, int(rows * (most or PART_BYTES) // max(1, batch.nbytes)))
    for low in range(0, rows, step):
        yield batch.slice(low, step)


def hashed_counts(dim: int):
    """Feature-hashing encoder over token lists: unit-length float vectors.

    Works on whole Arrow batches: distinct tokens are hashed once per batch, counts are
    one ``bincount`` over (row, slot).
    """

    def unit_vectors(tokens: pa.Array) -> pa.Array:
        rows = len(tokens)
        lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        words = tokens.flatten().dictionary_encode()
        slots = np.array([token_slot(w, dim) for w in words.dictionary.to_pylist()], dtype=np.int64)
        cells = np.repeat(np.arange(rows), lengths) * dim
        if len(cells):
            cells = cells + slots[words.indices.to_numpy(zero_copy_only=False)]
        counts = np.bincount(cells, minlength=rows * dim).reshape(rows, dim).astype(np.float64)
        norms = np.sqrt((counts * counts).sum(axis=1))
        unit = (counts / np.maximum(norms, fixed.NORM_EPS)[:, None]).astype(np.float32)
        offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(offsets, pa.array(unit.reshape(-1)))

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def encode(tokens: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.list_(pa.float32())), *(unit_vectors(part) for part in bounded(tokens))])

    return encode
