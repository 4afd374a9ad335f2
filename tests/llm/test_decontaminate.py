import random
import re
from collections import Counter

import numpy as np
from lectern.llm import decontaminate

DOCS = "doc_id long, text string, row string, item_id string, similarity int"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(ws, n):
    return Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))


def brute(texts, items, threshold=0.8):
    found = {}
    for d, text in texts:
        ws = words(text)
        for k, item in items:
            own = words(item)
            n = min(5, len(own))
            if not own or len(ws) < n:
                continue
            want = grams(own, n)
            best = 0
            for i in range(max(1, len(ws) - len(own) + 1)):
                have = grams(ws[i : i + len(own)], n)
                both = sum((have & want).values())
                best = max(best, both / sum((have | want).values()))
            if best >= threshold:
                found[d, k] = round(best, 9)
    return found


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "ñandú"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 15, 30, 59])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "..."), (103, items[4][1]), (104, "same same same same same same same same")]
    texts = []
    for d in range(150):
        parts = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.6:
            own = words(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                if own:
                    own[rng.randrange(len(own))] = "changed"
            own = [rng.choice([w, w.upper(), w + ",", f"«{w}»", w + "…"]) for w in own]
            at = rng.randint(0, len(parts))
            parts[at:at] = own
        texts.append((d, rng.choice([" ", "\n", ", "]).join(parts)))
    short = words(items[5][1])
    return [*texts, (900, None), (901, ""), (902, " ".join(short[:-1])), (903, "same " * 12)], items


def run(spark, texts, items):
    docs = spark.createDataFrame([(d, t, "r", "i", 1) for d, t in texts], DOCS).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.contaminated(docs, bench).collect()}


def test_equals_brute_force(spark):
    texts, items = corpus()
    want = brute(texts, items)
    assert len(want) > 60 and run(spark, texts, items) == want


def test_several_passes_give_the_same(spark, monkeypatch):
    texts, items = corpus(2)
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 700)
    assert run(spark, texts, items) == brute(texts, items)


def test_block_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 256, (300, 8)).astype(np.uint8)
    asked = prints[:50].copy()
    for row in asked:
        for bit in rng.choice(64, rng.integers(0, 30), replace=False):
            row[bit // 8] ^= 1 << (bit % 8)
    index = decontaminate.BlockIndex(prints, 23)
    got = set(zip(*(v.tolist() for v in index.find(asked)), strict=True))
    want = {(i, j) for i in range(50) for j in range(300) if decontaminate.distances(asked[i], prints[j]) <= 23}
    assert got == want


def test_empty_tables_and_drop(spark, tmp_path):
    texts, items = corpus(3)
    assert run(spark, [], items) == {} and run(spark, texts, []) == {}
    spark.createDataFrame([(d, t, "r", "i", 1) for d, t in texts], DOCS).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    bad = {d for d, _ in brute(texts, items)}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in texts} - bad
