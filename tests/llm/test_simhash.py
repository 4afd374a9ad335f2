import random
import re

import numpy as np
import pytest
import xxhash
from lectern.llm import simhash
from lectern.llm.common import written

SCHEMA = "doc_id long, text string, bits string, least int, cell string"


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=2):
    """Smallest index reachable, by full comparison of distinct fingerprints."""
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(p) for p in prints]


def brute(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = components(prints)
    least = {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(rows, prints, roots)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "ABC", "x" * 90]
    base = [[rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 40, 400]))] for _ in range(40)]
    texts = []
    for _ in range(150):
        ws = list(rng.choice(base))
        if ws and rng.random() < 0.6:
            ws[rng.randrange(len(ws))] = rng.choice(words)
        texts.append(rng.choice([" ", "\n", " \t ", "\x0b"]).join(ws) + rng.choice(["", " ", "\n\n"]))
    return texts


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "b", 1, "c") for d, t in rows], SCHEMA).repartition(3)
    return sorted([(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    texts = corpus(seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    rows = list(zip(ids, texts)) + [(1000, None), (1001, ""), (1002, " \n\x1f"), (None, texts[0]), (None, "only here"), (5, texts[2]), (5, texts[2])]
    expected = brute(rows)
    assert run(spark, rows) == expected
    assert any(r[0] != r[2] for r in expected)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_equal_full_comparison(spark, radius):
    rng = random.Random(radius)
    marks = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            marks.add(p)
            p ^= 1 << rng.randrange(64) if rng.random() < 0.7 else 3 << rng.randrange(63)
    marks |= {0, (1 << 64) - 1, 1 << 63, 3 << 62}
    signed = {simhash._signed(p) for p in marks}
    table = written(spark.createDataFrame([(p,) for p in signed], "bits long"), "given")
    found = sorted(tuple(r) for r in simhash.links(table, radius).collect())
    mask = (1 << 64) - 1
    assert found == sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= radius)


def test_parts_of_long_texts_give_the_same_fingerprint(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice(["a", "bC", "dé", " ", "\n", "  "]) for _ in range(5000)) + "z" * 700 + " end"
    data = np.frombuffer(text.encode(), np.uint8)
    expected = brute_fingerprint(text)
    for block in (1 << 20, 1000, 64, 7):
        monkeypatch.setattr(simhash, "TEXT_BLOCK", block)
        monkeypatch.setattr(simhash, "SHINGLE_BLOCK", 13)
        assert simhash.fingerprint(data) == expected
        assert simhash.fingerprint(np.frombuffer(b"  one\n" + b" " * 50 + b"TWO ", np.uint8)) == brute_fingerprint("one two")


def test_spark_hashes_shingles_alike(spark):
    row = spark.sql("SELECT xxhash64('one two three') AS h").first()
    assert row.h == simhash._signed(xxhash.xxh64_intdigest(b"one two three", 42))


def test_empty_table_and_large_radius(spark):
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "bits long"), 3)


def test_cells_are_never_broadcast(spark):
    marks = written(spark.range(2000).selectExpr("xxhash64(id) AS bits", "id AS least"), "marks")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 2000 * 16
    found = simhash.links(marks)
    assert found.collect() == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
