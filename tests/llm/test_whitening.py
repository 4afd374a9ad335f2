import math
import random
from fractions import Fraction

import numpy as np
import pytest
from lectern.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, x string, n int, given string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "g") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, width):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and None not in v and all(math.isfinite(c) for c in v) and len(v) == width]
    distinct = sorted({tuple(x) for _, x in kept})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    cov = [[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in distinct), n**3)) for j in range(width)] for i in range(width)]
    values, vectors = np.linalg.eigh(np.array(cov))
    order = np.argsort(values)[::-1]
    return kept, n, sums, values[order], vectors[:, order]


def compare(spark, rows, width, components=4):
    kept, n, sums, values, vectors = brute(rows, width)
    found = whitening.whiten(frame(spark, rows), components).collect()
    k = len({r.component for r in found})
    assert len(found) == k * len(kept) and k == min(components, int((values > 1e-9 * values[0]).sum()))
    by = {}
    for r in found:
        by.setdefault((r.vec_id, r.deviation, r.component), []).append(r)
    signs = {}
    for vec_id, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for c in range(k):
            r = by[vec_id, deviation, c + 1].pop()
            expected = float((np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ vectors[:, c]) / math.sqrt(values[c]))
            if abs(expected) > 1e-6:
                assert signs.setdefault(c, math.copysign(1, expected * r.whitened)) == math.copysign(1, expected * r.whitened)
            assert abs(r.whitened) == pytest.approx(abs(expected), abs=1e-7)
            assert r.n == n and r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9) and r.identity_error < 1e-6


def test_equals_exact_arithmetic(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1 + j) + 3 * j for j in range(6)]) for i in range(120)]
    rows += [(500 + i, rows[3][1]) for i in range(60)]
    rows += [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (903, [math.nan] * 6), (904, [math.inf] + [0.0] * 5), (905, [1.0, 2.0]), (None, rows[5][1]), (7, rows[9][1])]
    compare(spark, rows, 6)


def test_large_entries_stay_exact(spark):
    rng = random.Random(2)
    compare(spark, [(i, [rng.uniform(-1, 1) * 1e5 for _ in range(3)]) for i in range(50)], 3)


def test_fewer_dimensions_and_no_variance(spark):
    compare(spark, [(i, [float(i), float(-i * i)]) for i in range(20)], 2)
    compare(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)], 3)
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []


def test_square_sums_are_exact_at_every_size():
    rng = random.Random(3)
    for bits in (8, 30, 40, 49, 60, 70):
        for rows in (0, 1, 5, 3000):
            values = [[rng.randrange(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(rows)]
            array = np.array(values, np.int64 if bits < 63 else object).reshape(rows, 3)
            assert whitening.square_sums(array) == [sum(v[j] ** 2 for v in values) for j in range(3)]


def test_vectors_of_many_rows_centre_as_python_numbers():
    x = np.array([[1 << 40, -5], [3, 4]], np.int64)
    n, sums = 1 << 30, [7, 9]
    assert whitening.centred(x, n, sums).tolist() == [[n * a - s for a, s in zip(row, sums)] for row in x.tolist()]


def test_registered_query(spark, sf):
    from lectern.llm.queries import QUERIES

    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in table.collect()]
    kept, n, sums, values, vectors = brute(rows, 64)
    found = QUERIES["op13_embedding_whitening"](spark, sf).toPandas()
    assert len(found) == 4 * len(kept)
    z = {i: [n * a - s for a, s in zip(x, sums)] for i, x in kept}
    assert all(sum(c * c for c in z[i]) == d for i, d in zip(found.vec_id, found.deviation))
    for c in range(4):
        own = found[found.component == c + 1].set_index("vec_id").whitened
        expected = np.array([np.array(z[i]) / n @ vectors[:, c] / math.sqrt(values[c]) for i in own.index])
        assert np.allclose(own, expected) or np.allclose(own, -expected)
