import hashlib
import random

import numpy as np
import pytest
from lectern.llm import substring

SCHEMA = "doc_id long, text string, row string, name int, first string"


def brute(rows, window):
    texts = [(d if d is not None else float("inf"), (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, ws in texts:
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i : i + window])
            least[k] = min(least.get(k, d), d)
    found = []
    for (doc_id, _), (d, ws) in zip(rows, texts):
        gone = set()
        for i in range(len(ws) - window + 1):
            if least[tuple(ws[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(ws) if i not in gone]
        found.append((doc_id, len(ws), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(found, key=str)


def corpus(seed, n=80):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)] + ["é", " x"]
    passages = [[rng.choice(words) for _ in range(rng.choice([10, 49, 50, 51, 80]))] for _ in range(6)] + [["der"] * 70]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 90))]
        texts.append(rng.choice([" ", "\n", "  \t"]).join(parts))
        if texts and rng.random() < 0.15:
            texts.append(rng.choice(texts))
    return texts


def run(spark, rows, window=50, **options):
    docs = spark.createDataFrame([(d, t, "r", 1, "f") for d, t in rows], SCHEMA).repartition(3)
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs, window, **options).collect()], key=str)


@pytest.mark.parametrize(("seed", "window", "options"), [(1, 50, {}), (2, 50, {"group_stretches": 2}), (3, 20, {"group_stretches": 6}), (4, 8, {})])
def test_equals_brute_force(spark, seed, window, options):
    texts = corpus(seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    rows = list(zip(ids, texts)) + [(1000, None), (1001, ""), (None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[2]), (-3, texts[3])]
    assert run(spark, rows, window, **options) == brute(rows, window)


def test_small_forests(spark, monkeypatch):
    monkeypatch.setattr(substring, "FOREST_BYTES", 1)
    rows = list(enumerate(corpus(9, 40)))
    assert run(spark, rows) == brute(rows, 50)


def test_long_text_and_empty_table(spark):
    rng = random.Random(1)
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(1, long), (0, " ".join(long.split()[100:40_000])), (2, "a " * 3000), (3, "a " * 100)]
    assert run(spark, rows) == brute(rows, 50)
    assert run(spark, []) == []


def test_sliding_least():
    x = np.random.default_rng(0).integers(0, 100, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 43, 64):
        assert (substring.sliding_least(x, width) == [x[i : i + width].min() for i in range(len(x) - width + 1)]).all()
