import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import vectors
from lectern.operators import embedding, ordinals, retrieval

RNG = np.random.default_rng(3)
X = RNG.standard_normal((120, 16))
X /= np.linalg.norm(X, axis=1, keepdims=True)
X[7] = X[3]  # equal vectors: equal scores


def items(spark, matrix=X, parts=3):
    rows = [(int(i), [float(v) for v in x], int(i % 4)) for i, x in enumerate(matrix)]
    return spark.createDataFrame(rows, "item_id long, embedding array<double>, label int").repartition(parts)


def asked(spark, matrix=X):
    return items(spark, matrix).select(F.col("item_id").alias("query_id"), "embedding")


def brute(scores, k, skip=True):
    best = {}
    for q, row in enumerate(scores):
        order = sorted((-round(s, 9), i) for i, s in enumerate(row) if not (skip and i == q))
        best[q] = [i for _, i in order[:k]]
    return best


def ranked(hits):
    found = {}
    for r in hits.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["item_id"])
    return found


@pytest.mark.parametrize("strategy", ["in_place", "cells"])
@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_exact_search(spark, strategy, metric):
    scores = X @ X.T if metric == "ip" else -((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    hits = retrieval.knn_exact(items(spark), asked(spark), 5, metric, skip_same_id=True, strategy=strategy)
    assert ranked(hits) == brute(scores, 5)


def test_many_queries_leave_the_broadcast_path(spark):
    hits = retrieval.knn_exact(items(spark), asked(spark), 5, skip_same_id=True, broadcast_rows=10)
    assert ranked(hits) == brute(X @ X.T, 5)
    with pytest.raises(ValueError):
        retrieval.knn_exact(items(spark), asked(spark), 5, strategy="in_place", broadcast_rows=10)


def test_a_cell_is_cut_into_fragments(spark):
    # All items and queries in one cell, fragments of a few rows each.
    kernel = retrieval.VectorKernel("ip", True)
    pool, queries = items(spark).select("item_id", "embedding"), asked(spark)
    found = retrieval.search_cells(pool, queries, kernel, 5, cell_items=20, cell_queries=15)
    per_cell = found.groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert per_cell > 5  # several fragments answered
    hits = ordinals.top_rows(found, ["query_id"], [F.col("score").desc(), F.col("item_id")], 5)
    assert ranked(hits) == brute(X @ X.T, 5)


def test_ties_go_to_the_smaller_id(spark):
    same = np.tile(X[0], (40, 1))
    for strategy in ("in_place", "cells"):
        hits = retrieval.knn_exact(items(spark, same), asked(spark, same[:2]), 3, strategy=strategy)
        assert ranked(hits) == {0: [0, 1, 2], 1: [0, 1, 2]}


def test_string_ids_and_missing_vectors(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", None)]
    pool = spark.createDataFrame(rows, "item_id string, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("z", None)], "query_id string, embedding array<float>")
    assert ranked(retrieval.knn_exact(pool, queries, 5)) == {"q": ["a", "b"]}


def test_squared_distance_and_similarity(spark):
    pool = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "item_id long, embedding array<double>")
    queries = spark.createDataFrame([(9, [0.0, 0.0])], "query_id long, embedding array<double>")
    rows = retrieval.knn_exact(pool, queries, 2, "l2").orderBy("rank").collect()
    assert [(r["distance"], r["score"]) for r in rows] == [(0.0, 1.0), (25.0, 1 / 26)]


def test_filter_before_and_after(spark):
    allowed = [i for i in range(len(X)) if i % 4 == 1]
    scores = X @ X.T
    before = ranked(retrieval.knn_filtered(items(spark), asked(spark), {"label": 1}, 4, "pre", skip_same_id=True))
    assert before == {q: [i for i in ids if i in allowed][:4] for q, ids in brute(scores, len(X)).items()}
    after = ranked(retrieval.knn_filtered(items(spark), asked(spark), {"label": 1}, 4, "post", skip_same_id=True))
    expected = {q: [i for i in ids if i in allowed][:4] for q, ids in brute(scores, 12).items()}
    assert after == {q: ids for q, ids in expected.items() if ids}


def test_probing_every_list_is_exact(spark):
    index = retrieval.ivf_build(items(spark), nlist=6)
    hits = retrieval.ivf_search(index, asked(spark), 5, nprobe=6, skip_same_id=True, cell_items=10, cell_queries=10)
    assert ranked(hits) == brute(X @ X.T, 5)


def test_one_hot_list_and_bucket(spark):
    # Nearly all vectors point one way: one list and one bucket hold almost everything.
    hot = np.vstack([np.ones((100, 16)) + RNG.standard_normal((100, 16)) * 1e-3, -np.ones((5, 16))])
    hot /= np.linalg.norm(hot, axis=1, keepdims=True)
    exact = brute(hot @ hot.T, 3)
    index = retrieval.ivf_build(items(spark, hot), nlist=2)
    hits = retrieval.ivf_search(index, asked(spark, hot), 3, nprobe=2, skip_same_id=True, cell_items=9, cell_queries=9)
    assert ranked(hits) == exact
    hits = retrieval.lsh_search(
        items(spark, hot), asked(spark, hot), 3, tables=2, bits=2, skip_same_id=True, cell_items=9, cell_queries=9
    )
    assert ranked(hits) == exact


def test_approximate_search_in_place_equals_cells(spark, tmp_path):
    index = retrieval.ivf_store(retrieval.ivf_build(items(spark), nlist=6), str(tmp_path / "index"))
    for probes in (1, 2, 6):
        near = retrieval.ivf_search(index, asked(spark), 5, nprobe=probes, skip_same_id=True)
        far = retrieval.ivf_search(index, asked(spark), 5, nprobe=probes, skip_same_id=True, broadcast_rows=3, cell_items=9)
        assert ranked(near) == ranked(far)
    near = retrieval.lsh_search(items(spark), asked(spark), 5, tables=4, bits=3, skip_same_id=True)
    far = retrieval.lsh_search(items(spark), asked(spark), 5, tables=4, bits=3, skip_same_id=True, broadcast_rows=3)
    assert ranked(near) == ranked(far)


def test_approximate_search_shuffles_no_vector(spark, tmp_path):
    index = retrieval.ivf_store(retrieval.ivf_build(items(spark), nlist=4), str(tmp_path / "index"))
    for found in (retrieval.ivf_search(index, asked(spark), 3, nprobe=2), retrieval.lsh_search(items(spark), asked(spark), 3, tables=2, bits=2)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan and "FlatMapCoGroups" not in plan
        for line in plan.splitlines():
            assert "Exchange" not in line or "embedding" not in line


def test_lexical_cost_follows_the_matches():
    """8,000 queries of rare terms cost at most 10 times as much per item as 400."""
    import time

    import pyarrow as pa

    rng = np.random.default_rng(1)
    tokens = [[f"t{v}" for v in rng.integers(0, 80_000, 500)] for _ in range(200)]
    block = pa.table({"item_id": np.arange(200), "tokens": tokens})
    kernel = retrieval.LexicalKernel(1.2, 0.75, 500.0)
    took = {}
    for n in (400, 8_000):
        terms = [[f"t{v}" for v in rng.integers(0, 80_000, 10)] for _ in range(n)]
        prepared = kernel.prepare(pa.table({"query_id": np.arange(n), "terms": terms, "weights": [[1.0] * 10] * n}))
        start = time.perf_counter()
        list(kernel(block, prepared, 5))
        took[n] = time.perf_counter() - start
    assert took[8_000] < 10 * max(took[400], 0.02)


def test_lexical_blocks_do_not_change_scores(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    block = pa.table({"item_id": np.arange(60), "tokens": [[f"t{v}" for v in rng.integers(0, 30, rng.integers(0, 40))] for _ in range(60)]})
    kernel = retrieval.LexicalKernel(1.2, 0.75, 20.0)
    prepared = kernel.prepare(
        pa.table({"query_id": np.arange(20), "terms": [[f"t{v}" for v in rng.choice(40, 6, False)] for _ in range(20)], "weights": [[1.5] * 6] * 20})
    )
    whole = retrieval._candidates(list(kernel(block, prepared, 4)), 4).reset_index(drop=True)
    monkeypatch.setattr(retrieval, "_BLOCK", 50)
    parts = retrieval._candidates(list(kernel(block, prepared, 4)), 4).reset_index(drop=True)
    assert whole.equals(parts) and len(whole) > 50


def test_bucketed_recall(spark):
    exact = retrieval.knn_exact(items(spark), asked(spark), 5, skip_same_id=True)
    found = retrieval.lsh_search(items(spark), asked(spark), 5, tables=16, bits=3, skip_same_id=True)
    row = retrieval.recall(found, exact).first()
    assert row["expected"] == 5 * len(X) and row["recall"] > 0.8


DOCS = ["the cat sat", "the dog sat on the mat", "cat and dog", "", "bird", "the the the cat"]


def bm25_by_hand(query, k1=1.2, b=0.75):
    words = [d.lower().split() for d in DOCS]
    mean = sum(map(len, words)) / len(words)
    scores = {}
    for i, w in enumerate(words):
        s = 0.0
        for term in set(query.lower().split()):
            df = sum(term in d for d in words)
            tf = w.count(term)
            if tf:
                s += np.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / mean))
        if s > 0:
            scores[i] = s
    return scores


@pytest.mark.parametrize("strategy", ["in_place", "cells"])
def test_bm25(spark, strategy):
    pool = spark.createDataFrame(list(enumerate(DOCS)), "item_id long, text string").repartition(3)
    questions = ["The cat", "dog mat dog", "unknown words"]
    queries = spark.createDataFrame(list(enumerate(questions)), "query_id long, text string")
    rows = retrieval.bm25(pool, queries, 10, strategy=strategy).orderBy("query_id", "rank").collect()
    for q, text in enumerate(questions):
        found = {r["item_id"]: r["score"] for r in rows if r["query_id"] == q}
        assert found == pytest.approx(bm25_by_hand(text), abs=1e-8)


def test_fusion_counts_missing_hits_as_zero(spark):
    schema = "query_id long, item_id long, score double"
    vector = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.1)], schema)
    text = spark.createDataFrame([(1, 2, 7.0), (1, 3, 2.0), (2, 5, 1.0)], schema)
    rows = {(r["query_id"], r["item_id"]): r["combined_score"] for r in retrieval.fuse(vector, text).collect()}
    assert rows == pytest.approx({(1, 1): 0.7, (1, 2): 0.3, (1, 3): 0.0, (2, 5): 0.3})


def source(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id string, text string, embedding array<double>")


def test_rerank_merges_sources_or_keeps_their_order(spark):
    chunk = source(spark, ("c1", "a b", [1.0, 0.0]), ("c2", "a", [0.9, 0.1]))
    table = source(spark, ("t1", "a b", [0.95, 0.0]), ("t2", "x", [0.0, 1.0]))
    queries = spark.createDataFrame([(1, "A B", [1.0, 0.0])], "query_id long, text string, embedding array<double>")
    sources = {"chunk": chunk, "table": table}
    by_score = retrieval.search_and_rerank(sources, queries, 2, rerank=False).orderBy("rank").collect()
    assert [r["item_id"] for r in by_score] == ["c1", "t1"]
    by_source = retrieval.search_and_rerank(sources, queries, 2, rerank=False, order="source").orderBy("rank").collect()
    assert [r["item_id"] for r in by_source] == ["c1", "c2"]
    reranked = retrieval.search_and_rerank(sources, queries, 3).orderBy("rank").collect()
    assert [(r["item_id"], r["rerank_score"]) for r in reranked] == [("c1", 1.0), ("t1", 1.0), ("c2", 0.5)]


def test_plugged_scorer_and_encoder(spark):
    def load_scorer():
        return lambda queries, documents: np.array([len(d) for d in documents], dtype=float)

    pairs = spark.createDataFrame([("q", "abc"), ("q", "a")], "query_text string, text string")
    assert sorted(r["rerank_score"] for r in retrieval.score_pairs(pairs, load_scorer).collect()) == [1.0, 3.0]

    def load_encoder():
        return lambda texts: np.array([[len(t), 0.0] for t in texts], dtype=float)

    df = spark.createDataFrame([("abc",), ("",), (None,)], "text string")
    vectors_found = sorted(r["embedding"] for r in embedding.embed_with(df, "text", load_encoder, 2).collect())
    assert vectors_found == [[0.0, 0.0], [0.0, 0.0], [1.0, 0.0]]


def test_default_encoder_is_unit_length_and_deterministic(spark):
    df = spark.createDataFrame([(1, "one two two"), (2, ""), (3, None)], "id int, text string")
    rows = {r["id"]: np.array(r["embedding"]) for r in embedding.embed(df, dim=32).collect()}
    assert np.isclose(np.linalg.norm(rows[1]), 1.0, atol=1e-6)
    assert not rows[2].any() and not rows[3].any() and len(rows[3]) == 32
    again = {r["id"]: np.array(r["embedding"]) for r in embedding.embed(df.repartition(3), dim=32).collect()}
    assert (rows[1] == again[1]).all()


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(vectors.l2_normalize(F.col("a")).alias("n"), vectors.cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert row["n"] == [0.0, 0.0] and row["c"] is None


def test_mean_pool_with_mask(spark):
    rows = [("k", [1.0, 2.0], 1), ("k", [3.0, 4.0], 1), ("k", [100.0, 100.0], 0), ("z", [5.0, 5.0], 0)]
    df = spark.createDataFrame(rows, "key string, vector array<double>, mask int").repartition(3)
    pooled = {r["key"]: r["pooled"] for r in embedding.mean_pool(df, "key", mask="mask").collect()}
    assert pooled == {"k": [2.0, 3.0], "z": [0.0, 0.0]}


def test_running_number_in_a_hot_group(spark):
    # Two thirds of all rows in one group, many equal first order values.
    rows = [("hot" if i % 3 else f"g{i % 30}", i // 7, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, a int, b int").repartition(5)
    numbered = ordinals.running_number(df, ["g"], ["a", "b"], "n", slices=16)
    expected = df.selectExpr("*", "row_number() OVER (PARTITION BY g ORDER BY a, b) AS n")
    assert numbered.exceptAll(expected.withColumn("n", F.col("n").cast("long"))).count() == 0
    assert numbered.count() == 3000


def test_running_number_without_groups(spark):
    df = spark.range(1000).withColumn("x", F.lit(1))
    rows = ordinals.running_number(df, [], ["id"], "n", slices=8)
    assert rows.filter("n <> id + 1").count() == 0
    assert ordinals.running_number(df.limit(0), [], ["id"], "n", slices=8).count() == 0
    assert ordinals.running_number(df, [], ["id"], "n").filter("n <> id + 1").count() == 0


def test_running_number_orders_strings(spark):
    # No order column is numeric; one group holds most rows.
    rows = [("hot" if i % 4 else None, f"U_chunk_{i}", "x" * (i % 3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, a string, b string").repartition(5)
    numbered = ordinals.running_number(df, ["g"], ["a", "b"], "n", slices=16)
    expected = df.selectExpr("*", "cast(row_number() OVER (PARTITION BY g ORDER BY a, b) AS long) AS n")
    assert numbered.exceptAll(expected).count() == 0 and numbered.count() == 2000
    alone = ordinals.running_number(df, [], ["a"], "n", slices=16)
    assert [r["n"] for r in alone.orderBy("a").collect()] == list(range(1, 2001))


def test_slices_split_a_hot_group(spark):
    df = spark.range(8000).select(F.lit("hot").alias("g"), F.col("id").cast("string").alias("id"))
    seen = df.repartitionByRange(16, "g", "id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert seen < 8000 / 16 * 2


def test_top_rows_beyond_the_pruned_rank(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("g"), "id").repartition(4)
    found = ordinals.top_rows(df, ["g"], [F.col("id").desc()], 2000)
    expected = df.selectExpr("*", "row_number() OVER (PARTITION BY g ORDER BY id DESC) AS rank").filter("rank <= 2000")
    assert found.exceptAll(expected).count() == 0 and found.count() == 4000
    # Two stages: slices of a group are ranked before the group meets.
    assert found._jdf.queryExecution().executedPlan().toString().count("Window [") == 2


def test_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 4)], "k string, o int")
    assert {(r["k"], r["o"]) for r in retrieval.dedup_first(df, ["k"], ["o"]).collect()} == {("a", 1), (None, 4)}


def test_batches_by_length_pad_less_and_keep_vectors(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string")
    ).repartition(2).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 40)).otherwise(F.col("text")))

    def loader(log):
        def load():
            def encode(texts):
                sizes = [len(t.split()) for t in texts]
                with open(log, "a") as out:
                    out.write(f"{max(sizes) * len(sizes) - sum(sizes)}\n")
                return np.array([[len(t), t.count("e") + 1.0] for t in texts])

            return encode

        return load

    found = {}
    for name, embed in (("plain", embedding.embed_with), ("sorted", embedding.embed_by_length)):
        log = str(tmp_path / name)
        rows = embed(docs, "text", loader(log), 8).collect()
        assert embed(docs, "text", loader(log + "2"), 8).columns == ["doc_id", "text", "embedding"]
        found[name] = ({r.doc_id: r.embedding for r in rows}, sum(map(int, open(log))))
    assert found["plain"][0] == found["sorted"][0] and len(found["plain"][0]) == docs.count()
    print(found["plain"][1], found["sorted"][1])
    assert found["sorted"][1] < found["plain"][1] / 3
