import numpy as np
import pyarrow as pa
import pytest
from lectern.operators import probing, retrieval


def unit(rng, n, dim=64):
    x = rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, key):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{key} long, embedding array<double>").repartition(3)


@pytest.mark.parametrize(("n", "share"), [(500, 1.0), (5_000, 0.6), (50_000, 1 / 3)])
def test_recall_holds_as_the_table_grows(n, share):
    """The kernel over random vectors, the hardest case: neighbours are hardly nearer than the rest."""
    rng = np.random.default_rng(n)
    x, q = unit(rng, n), unit(rng, 100)
    planes = np.random.default_rng(7).standard_normal((probing.BITS, 64))
    scores = q @ x.T
    best = np.argsort(-scores, axis=1)[:, :10]
    cosine = float(np.quantile(np.take_along_axis(scores, best, 1)[:, 9], 0.25))
    kernel = probing.ProbeKernel(planes, cosine, 0.9)
    table = pa.table({"query_id": np.arange(len(q)), "embedding": q.tolist()})
    prepared = kernel.prepare(table)
    met = np.zeros(scores.shape, bool)
    for item, query in kernel.pairs(probing.codes(x, planes), prepared):
        met[query, item] = True
    assert np.take_along_axis(met, best, 1).mean() >= 0.9
    assert met.mean() <= share


def test_stored_index_finds_neighbours(spark, tmp_path):
    rng = np.random.default_rng(1)
    x, q = unit(rng, 5_000), unit(rng, 60)
    items, asked = frame(spark, x, "item_id"), frame(spark, q, "query_id")
    index = probing.probe_store(probing.probe_build(items), str(tmp_path / "index"))
    exact = retrieval.knn_exact(items, asked, 10)
    in_place = probing.probe_search(index, asked, 10)
    measured = retrieval.recall(in_place, exact).first()
    assert measured.queries == 60 and measured.recall >= 0.9
    assert probing.probed_share(index, asked, 10) < 0.7
    cells = probing.probe_search(index, asked, 10, strategy="cells")
    assert sorted(map(tuple, cells.select("query_id", "item_id", "rank").collect())) == sorted(map(tuple, in_place.select("query_id", "item_id", "rank").collect()))


def test_close_neighbours_need_few_probes(spark):
    rng = np.random.default_rng(2)
    centres = unit(rng, 200)
    x = np.repeat(centres, 20, axis=0) + 0.05 * rng.standard_normal((4_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    items, asked = frame(spark, x, "item_id"), frame(spark, centres[:50], "query_id")
    index = probing.probe_build(items)
    assert probing.probed_share(index, asked, 10) < 0.02
    assert retrieval.recall(probing.probe_search(index, asked, 10), retrieval.knn_exact(items, asked, 10)).first().recall >= 0.9


def test_small_and_odd_tables(spark):
    none = spark.createDataFrame([], "item_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<double>")
    assert probing.probe_search(probing.probe_build(none), asked, 3).collect() == []
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (1, [1.0, 0.0])], "item_id long, embedding array<double>")
    found = probing.probe_search(probing.probe_build(items, bits=4), asked, 1).collect()
    assert [(r.query_id, r.item_id) for r in found] == [(1, 1)]
    with pytest.raises(ValueError):
        probing.probe_build(items, bits=63)
    with pytest.raises(ValueError):
        probing.probe_search(probing.probe_build(items), asked, target=1.0)


def test_blocks_of_which_much_is_probed_are_multiplied_whole(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 16))
    x = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True)] * 2)  # every vector twice: ties go to the smaller id
    ids = np.append(np.arange(len(x))[::-1], [3, 7, 7])  # ids that come again are left out as well
    items = pa.table({"item_id": ids, "embedding": [*x[::-1], x[3], x[7], x[7]]})
    queries = pa.table({"query_id": np.arange(90), "embedding": list(x[:90])})
    kernel = probing.ProbeKernel(rng.standard_normal((12, 16)), 0.4, 0.9, skip_same_id=True)

    def hits():
        found = retrieval._candidates(list(kernel(items, kernel.prepare(queries), 5)), 5)
        return [tuple(r) for r in found[["query_id", "item_id"]].itertuples(index=False)], found["score"].to_numpy()

    monkeypatch.setattr(probing, "DENSE_SHARE", 2.0)
    expected, scores = hits()
    monkeypatch.setattr(probing, "DENSE_SHARE", 1 / 16)
    monkeypatch.setattr(retrieval, "_ITEM_BLOCK", 97)  # also beyond the first block
    monkeypatch.setattr(probing.ProbeKernel, "pairs", lambda *_: pytest.fail("a pair was picked out of a block"))
    found, again = hits()
    assert found == expected and np.allclose(scores, again, atol=2e-9) and len(found) == 450
