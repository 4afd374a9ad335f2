import numpy as np
import pytest
from lectern.operators import retrieval, two_level
from pyspark.sql import functions as F


def clustered(n_centres, each, seed, dim=32, noise=0.06):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n_centres, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.repeat(centres, each, axis=0) + noise * rng.standard_normal((n_centres * each, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, key):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{key} long, embedding array<double>").repartition(3)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    items = frame(spark, clustered(100, 60, 1), "item_id")
    built = two_level.two_level_build(items, list_items=60)
    return items, two_level.two_level_store(built, str(tmp_path_factory.mktemp("index") / "i"))


def test_recall_with_a_tenth_of_the_items(spark, index):
    items, stored = index
    assert 6 <= len(stored.roots) <= 14 and 60 <= stored.lists.count() <= 200
    assert stored.items.count() == 6000 and stored.items.filter("list_id < 0").isEmpty()
    asked = frame(spark, clustered(100, 60, 1)[::97], "query_id")
    exact = retrieval.knn_exact(items, asked, 10)
    found = two_level.two_level_search(stored, asked, 10, nprobe=4, roots=3)
    assert retrieval.recall(found, exact).first().recall >= 0.9
    assert two_level.scored_share(stored, asked, 4, 3) < 0.1
    cells = two_level.two_level_search(stored, asked, 10, nprobe=4, roots=3, broadcast_rows=5)
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, found.collect()))


def test_lists_grow_with_the_table_and_files_do_not(spark, index, tmp_path):
    small = two_level.two_level_build(frame(spark, clustered(100, 6, 1), "item_id"), list_items=60)
    assert small.lists.count() < index[1].lists.count() / 3
    assert len(index[1].items.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_all_lists_give_the_exact_result(spark, index):
    items, stored = index
    asked = frame(spark, clustered(7, 3, 5), "query_id")
    found = two_level.two_level_search(stored, asked, 5, nprobe=10_000, roots=len(stored.roots))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieval.knn_exact(items, asked, 5).collect()))


def test_hot_cluster_and_odd_tables(spark):
    x = np.concatenate([np.repeat(clustered(1, 1, 3), 400, axis=0), clustered(20, 10, 4)])
    built = two_level.two_level_build(frame(spark, x, "item_id").unionByName(spark.createDataFrame([(9999, None)], "item_id long, embedding array<double>")), list_items=50)
    assert built.items.count() == 600
    none = spark.createDataFrame([], "item_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert two_level.two_level_build(none).items.count() == 0
    one = two_level.two_level_build(spark.createDataFrame([(1, [1.0, 0.0])], "item_id long, embedding array<double>"))
    assert [(r.item_id, r.rank) for r in two_level.two_level_search(one, asked, 3).collect()] == [(1, 1)]


def test_stored_lists_have_few_files(spark, tmp_path):
    items = frame(spark, clustered(20, 50, 6), "item_id").repartition(12)
    stored = retrieval.ivf_store(retrieval.ivf_build(items, nlist=4), str(tmp_path / "ivf"), slices=2)
    files = stored.items.select("list_id", F.input_file_name().alias("f")).distinct().groupBy("list_id").count()
    assert files.agg(F.max("count")).first()[0] <= 2 and stored.items.count() == 1000


def test_queries_that_probe_many_lists_travel_without_them(spark, index):
    items, stored = index
    asked = frame(spark, clustered(100, 60, 1)[::41], "query_id")
    roots, n = len(stored.roots), stored.lists.count()
    found = two_level.two_level_search(stored, asked, 10, nprobe=n // 2, roots=roots // 2, skip_same_id=True, broadcast_rows=5)
    # Before, each query met every list that it probes as a row of its own.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Generate" in line and "list_id" in line for line in plan.split("\n"))
    few = two_level.two_level_search(stored, asked, 10, nprobe=n // 2, roots=roots // 2, skip_same_id=True)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, few.collect()))


def test_probed_lists_are_found_without_sorting_them(monkeypatch):
    rng = np.random.default_rng(3)
    centres, roots, root_of = rng.normal(size=(60, 8)), rng.normal(size=(5, 8)), rng.integers(0, 5, 60)
    centres[10:30] = centres[40:60]  # equal scores go to the lower list
    q = np.concatenate([rng.normal(size=(40, 8)), np.zeros((1, 8)), np.full((1, 8), np.nan)])
    expected = {}
    for nprobe in (1, 7, 48, 60, 100):
        for best_roots in (2, 5):
            below = np.zeros((len(q), 5), bool)
            np.put_along_axis(below, retrieval._best_lists(q, roots, best_roots), True, axis=1)
            scores = np.where(below[:, root_of], np.round(q @ centres.T, retrieval.SCORE_DECIMALS), -np.inf)
            rows, cols, _ = retrieval._best(scores, nprobe)
            expected[nprobe, best_roots] = np.zeros((len(q), 61), bool)
            expected[nprobe, best_roots][rows, cols] = expected[nprobe, best_roots][:, -1] = True

    def refused(*args):
        raise AssertionError("sorts every probed list of every query")

    monkeypatch.setattr(retrieval, "_best", refused)
    for held in (1, 200, 1 << 20):
        monkeypatch.setattr(two_level, "PROBED_SCORES", held, raising=False)
        for (nprobe, best_roots), found in expected.items():
            kernel = two_level.WideKernel(roots, centres, root_of, np.arange(60), nprobe, best_roots)
            assert (kernel.probed(q) == found).all(), (held, nprobe, best_roots)
