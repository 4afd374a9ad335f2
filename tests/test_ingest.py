from pyspark.sql import functions as F

from lectern.operators import filters, ingest


def test_metadata_filter_prefers_nested_fields(spark):
    rows = [(1, "x", ("CS", None)), (2, "y", ("CS", "2024")), (3, "x", ("EE", None))]
    df = spark.createDataFrame(rows, "id int, program string, metadata struct<program:string,year:string>")

    def ids(where):
        return [r["id"] for r in filters.filter_metadata(df, where).orderBy("id").collect()]

    assert ids({"program": "CS"}) == [1, 2]
    assert ids({"metadata.program": "CS", "year": None}) == [1]
    assert ids({"campus": None}) == [1, 2, 3]
    assert ids({"campus": "A"}) == []
    assert ids({}) == [1, 2, 3]


def test_text_search_wildcards(spark):
    df = spark.createDataFrame([(1, "100% sure"), (2, "100 sure"), (3, "1000 SURE")], "id int, text string")

    def ids(text, **options):
        return [r["id"] for r in filters.search_text(df, text, **options).collect()]

    assert ids("100% s") == [1]
    assert ids("100%s", literal=False) == [1, 2, 3]
    assert ids("sure", limit=2) == [1, 2]


def test_lookup_reports_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    keys = spark.createDataFrame([("a",), ("a",), ("z",)], "k string")
    assert sorted((r["v"], r["matches"]) for r in filters.lookup(df, keys, "k").collect()) == [(1, 2), (2, 2)]
    assert [r["k"] for r in filters.lookup_duplicates(df, keys, "k").collect()] == ["a"]


def test_normalized_metadata(spark):
    df = spark.createDataFrame([("U", "alias"), (None, None)], "university_id string, aliases string")
    rows = filters.normalize_metadata(df).collect()
    assert rows[0]["aliases"] == ["alias"] and rows[1]["aliases"] == []
    assert (rows[1]["university_id"], rows[1]["chunk_type"]) == ("", "unknown")


def test_merge_maps(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3", "a": "9"})], "x map<string,string>, y map<string,string>")
    merged = df.select(filters.merge_maps(F.col("x"), F.col("y")).alias("m")).first()["m"]
    assert merged == {"a": "9", "b": "2", "c": "3"}


def test_embedding_faults(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, nan]), (4, [inf, 0.0]), (5, None), (6, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    found = {r["id"]: r["reason"] for r in filters.validate_embeddings(df).collect()}
    assert found == {1: None, 2: "dimension", 3: "not finite", 4: "not finite", 5: "missing", 6: None}


def test_merge_is_idempotent(spark):
    existing = spark.createDataFrame([("a", "old")], "source_file string, path string")
    incoming = spark.createDataFrame([("a", "new"), ("b", "p2"), ("b", "p1")], "source_file string, path string")
    once = ingest.merge_documents(existing, incoming)
    assert sorted(map(tuple, once.collect())) == [("a", "old"), ("b", "p1")]
    assert sorted(map(tuple, ingest.merge_documents(once, incoming).collect())) == sorted(map(tuple, once.collect()))


def test_statistics_of_an_empty_log(spark):
    log = spark.createDataFrame([], "question_type string, response_time_ms int")
    found = {(r["statistic"], r["key"]): r["value"] for r in ingest.query_stats(log).collect()}
    assert found == {("avg_response_time_ms", None): 0.0, ("total_queries", None): 0.0}
    log = spark.createDataFrame([("qa", None), ("qa", 3), (None, 4)], "question_type string, response_time_ms int")
    found = {(r["statistic"], r["key"]): r["value"] for r in ingest.query_stats(log).collect()}
    assert found == {
        ("question_types", "qa"): 2, ("question_types", None): 1, ("total_queries", None): 3, ("avg_response_time_ms", None): 3.5,
    }


def test_cascade_follows_the_chain(spark):
    docs = spark.createDataFrame([(1,), (2,)], "id int")
    chunks = spark.createDataFrame([(10, 1), (20, 2)], "chunk int, doc int")
    embeddings = spark.createDataFrame([(100, 10), (200, 20), (300, 20)], "e int, chunk_ref int")
    kept = ingest.cascade_delete(
        {"docs": docs, "chunks": chunks, "embeddings": embeddings},
        "docs",
        docs.filter("id = 2"),
        {"chunks": ("docs", "doc", "id"), "embeddings": ("chunks", "chunk_ref", "chunk")},
        "id",
    )
    assert [r["e"] for r in kept["embeddings"].collect()] == [100]
    assert ingest.orphans(embeddings, kept["chunks"], "chunk_ref", "chunk").count() == 2


def test_log_defaults(spark):
    answers = spark.createDataFrame([("q", "a", 2, None), ("q", "a", 2, "summary")], "question string, answer string, num_sources int, question_type string")
    rows = ingest.log_rows(answers, llm_model="m").collect()
    assert [r["question_type"] for r in rows] == ["qa", "summary"]
    assert rows[0]["llm_model"] == "m" and rows[0]["timestamp"] is not None


def test_recent_queries(spark):
    log = spark.createDataFrame([(1, 7, 100), (2, 8, 300), (3, 7, 200)], "id int, user_id int, timestamp int")
    assert [r["id"] for r in ingest.recent_queries(log, 2).collect()] == [2, 3]
    assert [r["id"] for r in ingest.recent_queries(log, 5, user=7).collect()] == [3, 1]
    assert {(r["user_id"], r["id"]) for r in ingest.recent_per_user(log, 1).collect()} == {(7, 3), (8, 2)}
