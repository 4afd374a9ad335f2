import random
import re
import zlib
from collections import Counter

import pytest
from lectern.llm import spelling
from lectern.llm.common import written

SCHEMA = "doc_id long, text string, word string, n int, node string"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_counts(rows, length=6, least=5):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= length and n >= least}


def brute_variants(counts, ratio=5):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(rows)


def corpus(seed, n=400):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.choice([6, 7, 9, 14, 22, 40]))) for _ in range(40)] + ["ALLCAPS", "Été À la", "aaaaaa", "abababab"]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 20)):
            w = list(rng.choice(stems))
            if rng.random() < 0.4:
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b", "ab"])
            words.append("".join(w))
        texts.append(rng.choice([" ", "\n", ", ", "×-", " Ā "]).join(words))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = corpus(seed)
    rows = list(enumerate(texts)) + [(7, texts[0]), (7, texts[0]), (None, texts[1]), (None, None), (900, ""), (901, None), (902, "a" * 300_000)]
    docs = spark.createDataFrame([(d, t, "w", 1, "x") for d, t in rows], SCHEMA).repartition(3)
    counts = brute_counts(rows)
    found = sorted(tuple(r) for r in spelling.spelling_variants(docs).collect())
    assert found == brute_variants(counts)
    assert any(r[1] for r in found) and any(len(r[0]) > 30 for r in found)


def test_left_out_code_points(spark):
    rows = [(i, "Wörterbuch straightforward " * 3) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    assert found == brute_counts(rows) and len(found) > 3


def test_neighbours_of_words_sharing_edits_at_block_borders(spark, monkeypatch):
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(300)}
    words |= {"x" * 30, "x" * 31, "x" * 32, "x" * 15 + "y" + "x" * 15, "ÿ" * 13, "ÿ" * 12 + "a"}
    table = written(spark.createDataFrame([(w,) for w in words], "word string"), "given")
    expected = sorted((a, b) for a in words for b in words if one_edit(a, b))
    assert sorted(tuple(r) for r in spelling.neighbours(table).collect()) == expected
    monkeypatch.setattr(spelling, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(spelling, "SINGLE_LEVELS", 2)
    assert sorted(tuple(r) for r in spelling.neighbours(table).collect()) == expected


def test_very_long_words(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abc") for _ in range(5000))
    words = [long, long[:-1], long + "a", long[1:], long[:2500] + "z" + long[2501:], "z" + long]
    table = written(spark.createDataFrame([(w,) for w in words], "word string"), "given")
    assert sorted(tuple(r) for r in spelling.neighbours(table).collect()) == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, "short", "w", 1, "x")], SCHEMA)).collect() == []
