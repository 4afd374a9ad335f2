import random

import numpy as np
import pytest

from lectern.functions import arrow
from lectern.operators import chunking
from lectern.plans import QUERIES
from lectern.plans.text import offsets_loader

TEXTS = [
    "Plain words, twice. " * 40,
    "naïve façade — \u4f60\u597d \U0001f600\U0001f469\u200d\U0001f680 " * 12,
    "  leading and trailing  \n\n",
    "\U0001f9ff" * 60,
    "",
    None,
    "x",
]


def plain(text, offsets, size, step):
    """Windows token by token: a bound inside a character goes back to the character's first token."""
    inside = [i > 0 and offsets[i][0] < max(e for _, e in offsets[:i]) for i in range(len(offsets))] + [False]

    def bound(at, beyond):
        at = min(at, len(offsets))
        while inside[at]:
            at -= 1
        if at <= beyond:
            at = beyond + 1
            while inside[at]:
                at += 1
        return at

    found, first = [], 0
    while first < len(offsets):
        last = bound(first + size, first)
        begin = offsets[first][0] if first else 0
        end = offsets[last][0] if last < len(offsets) else len(text)
        found.append((text[begin:end], begin, end, last - first))
        first = bound(first + step, first)
    return found


@pytest.mark.parametrize(("size", "overlap"), [(7, 0), (7, 3), (1, 0), (64, 16)])
def test_windows_equal_a_plain_pass(spark, size, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    got = chunking.chunk_subwords(df, offsets_loader(), max_tokens=size, overlap=overlap).collect()
    offsets_of = offsets_loader()()
    for i, text in enumerate(TEXTS):
        rows = sorted((r for r in got if r.id == i), key=lambda r: r.window_idx)
        want = plain(text, offsets_of(text), size, size - overlap) if text else []
        assert [(r.chunk, r.start_char, r.end_char, r.n_tokens) for r in rows] == want, text
        if text and overlap == 0:
            assert "".join(r.chunk for r in rows) == text
        if size >= 7:
            assert all(r.n_tokens <= size for r in rows)


def test_bounds_at_any_split_of_characters():
    rng = random.Random(5)
    for _ in range(200):
        offsets, at = [], 0
        while len(offsets) < 40:
            width = rng.choice([1, 1, 2, 5])
            offsets += [(at, at + width)] * (rng.choice([1, 2, 3]) if width == 1 else 1)
            at += width + rng.choice([0, 0, 1])
        bounds = arrow.window_bounds(np.array(offsets), 8, 8)
        assert bounds[0][0] == 0 and bounds[-1][1] == len(offsets) and all(b - a <= 8 for a, b in bounds)
        assert all(x[1] == y[0] for x, y in zip(bounds, bounds[1:]))
        assert all(a == 0 or offsets[a][0] >= offsets[a - 1][1] for a, _ in bounds)


def test_query_over_whole_texts(spark, sf):
    rows = QUERIES["subword_windows"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    offsets_of, got = offsets_loader()(), {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    for doc, text in texts.items():
        want = plain(text, offsets_of(text), 512, 462) if text else []
        assert [(r.chunk, r.start_char, r.end_char, r.n_tokens) for r in sorted(got.get(doc, []), key=lambda r: r.window_idx)] == want
