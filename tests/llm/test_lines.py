import random

import pytest
from lectern.llm import lines

SCHEMA = "doc_id long, text string, row string, later int, doc string"


def split(text):
    parts = (text or "").split("\n")
    whole = [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])
    return whole


def brute(rows, size):
    seen, found = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        whole = split(text)
        bare = [w.removesuffix("\n") for w in whole]
        gone = set()
        for i in range(len(bare) - size + 1):
            key = tuple(bare[i : i + size])
            if key in seen:
                gone.update(range(i, i + size))
            seen.add(key)
        found.append((doc_id, len(whole), len(gone), "".join(w for i, w in enumerate(whole) if i not in gone)))
    return sorted(found, key=str)


def run(spark, rows, size=3):
    docs = spark.createDataFrame([(d, t, "r", 1, "d") for d, t in rows], SCHEMA).repartition(3)
    return sorted([(r.doc_id, r.n_lines, r.n_removed, r.text) for r in lines.remove_repeated_lines(docs, size).collect()], key=str)


@pytest.mark.parametrize(("seed", "size"), [(1, 3), (2, 2), (3, 1)])
def test_equals_brute_force(spark, seed, size):
    rng = random.Random(seed)
    known = ["a", "b", "", " ", "é" * 40, "long " * 30, "c\r", "d"]
    rows = [(i, "\n".join(rng.choice([*known, f"own {i} {j}"]) for j in range(rng.randint(0, 12))) + rng.choice(["", "\n"])) for i in range(120)]
    rng.shuffle(rows)
    rows += [(500, None), (501, ""), (502, "\n\n\n\n"), (None, rows[0][1]), (-1, "a\nb\nd")]
    assert run(spark, rows, size) == brute(rows, size)


def test_repeated_rows_and_hot_passage(spark):
    passage = "one\ntwo\nthree\nfour"
    rows = [(i, f"{passage}\nown {i}") for i in range(300)] + [(7000, "p\nq\nr"), (7000, "p\nq\nr")]
    found = run(spark, rows)
    assert [r for r in found if r[0] == 0] == [(0, 5, 0, f"{passage}\nown 0")]
    assert all(r[2:] == (4, f"own {r[0]}") for r in found if 0 < r[0] < 300)
    assert sorted(r[2] for r in found if r[0] == 7000) == [0, 3]


def test_long_text_and_empty_table(spark):
    text = "\n".join(str(i % 50_000) for i in range(100_000))
    assert run(spark, [(1, text)]) == brute([(1, text)], 3)
    assert run(spark, []) == []
