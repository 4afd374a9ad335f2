import random

import numpy as np
import pyarrow as pa
import pytest
from lectern.llm import jaccard, words
from lectern.llm.components import components


def brute(texts, size, percent):
    def grams(text):
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()

    sets = [grams(t) for t in texts]
    part = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                low, high = sorted((part[i], part[j]))
                part = [low if p == high else p for p in part]
    return [len(s) for s in sets], part


def near_copies(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "The", "THE"]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.7:
            base = rng.choice(texts).split()
            for _ in range(rng.randint(0, 6)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append("  ".join(base))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 5, 20, 60, 200]))))
    return texts


@pytest.mark.parametrize(("size", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 60, 3), (3, 100, 4)])
def test_components_equal_brute_force(spark, size, percent, seed):
    texts = near_copies(seed) + [None, "", " \n", "a b", "A\tB", "a b"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component string").repartition(3, "doc_id")
    rows = {r.doc_id: r for r in jaccard.jaccard_components(docs, size, percent).collect()}
    counts, part = brute(texts, size, percent)
    assert [rows[i].n_shingles for i in range(len(texts))] == counts
    assert [rows[i].component_id for i in range(len(texts))] == part


@pytest.mark.parametrize("percent", [50, 80, 90, 97])
def test_linked_sets_share_a_block(percent):
    rng = np.random.default_rng(percent)
    ranges = jaccard.Ranges(percent)
    for n in [1, 2, 5, 10, 50, 400]:
        for _ in range(40):
            a = np.unique(words.mix(rng.integers(0, 2**62, n).astype(np.uint64)))
            d = ranges.bound(ranges.of(len(a))[0])
            drop = rng.integers(0, d + 1)
            b = np.unique(np.concatenate([a[min(drop, len(a) - 1) :], words.mix(rng.integers(0, 2**62, rng.integers(0, d + 1)).astype(np.uint64))]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= percent * (len(a) + len(b) - common):
                assert np.intersect1d(jaccard.block_rows(a, ranges), jaccard.block_rows(b, ranges)).size


def test_hub_misses_are_made_good(spark):
    # 0 and 2 differ too much, 1 lies between them; all share blocks with the hub 0.
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join(base[8:] + [f"x{i}" for i in range(8)]), " ".join(base[24:] + [f"x{i}" for i in range(16)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert [found[i] for i in range(3)] == brute(texts, 3, 90)[1]


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(empty).count() == 0
    rows = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in jaccard.jaccard_components(rows).collect()) == [
        ("5", "5"), ("5", "5"), ("None", "5"), ("None", "None"),
    ]


def test_drop_keeps_one_of_each_group_and_all_columns(spark, tmp_path):
    texts = near_copies(7)
    spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, row string, component int").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    _, part = brute(texts, 5, 80)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(part[i] for i in ids) == sorted(set(part))


def test_components_of_long_chains(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in components(pairs).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_words_follow_the_separators():
    texts = ["a\x0bb  c", None, "", " x y z", " lead", "trail ", "A" * 100 + " B"]
    found = words.find_words(pa.array(texts), lower=True)
    split = [
        [found.data[s:e].tobytes().decode() for s, e in zip(found.starts[a:b], found.ends[a:b])]
        for a, b in zip(found.bounds[:-1], found.bounds[1:])
    ]
    assert split == [["a", "b", "c"], [], [], [" x y", "z"], ["lead"], ["trail"], ["a" * 100, "b"]]
    again = words.find_words(pa.array(["x", *texts]).slice(1), lower=True)
    assert (again.hashes == found.hashes).all()


def test_overlaps_count_common_columns(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.int64)) for n in (1, 5, 30, 50, 20)]
    want = [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:2]]
    assert jaccard.overlaps(sets[:2], sets[2:]).tolist() == want


def test_tiles_smaller_than_families(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 3)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        words_ = list(base)
        for _ in range(rng.randint(0, 4)):
            words_[rng.randrange(120)] = f"x{rng.randrange(50)}"
        texts.append(" ".join(words_))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4, "doc_id")
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert [found[i] for i in range(60)] == brute(texts, 3, 90)[1]


def test_large_blocks_meet_in_pairs_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 8)
    alike = jaccard._alike

    def bounded(percent):
        inner = alike(percent)

        def run(batches):
            seen = {}

            def counted():
                for batch in batches:
                    for group in batch.column(0).to_pylist():
                        seen[group] = seen.get(group, 0) + 1
                    assert max(seen.values(), default=0) <= 24, "a task holds a whole block"
                    yield batch

            yield from inner(counted())

        return run

    monkeypatch.setattr(jaccard, "_alike", bounded)
    # Forty rows of one part share a block with two strays, of which one is linked with a row of it.
    grams = {i: [*range(20), 1000 + i] for i in range(40)} | {100: [*range(20), 1005], 101: list(range(500, 521))}
    rest = spark.createDataFrame([(7, i, min(i, 100) // 100 * i) for i in grams], "block long, row long, part long")
    sets = spark.createDataFrame(
        [(i, len(g), g, bytearray(64)) for i, g in grams.items()], "row long, n_shingles long, grams array<long>, profile binary"
    )
    links = {tuple(sorted((r.a, r.b))) for r in jaccard._across(rest, sets, 90).collect()}
    assert links and all(a < 40 and b == 100 for a, b in links)
