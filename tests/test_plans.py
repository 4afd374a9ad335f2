import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking, embedding, ordinals, questions, retrieval
from lectern.plans import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# Cheap to run at the smallest scale; tools/check_oracles.py runs all of them.
COMPARED = [
    "knn_label_agreement", "token_windows", "paragraph_chunks", "keywords", "pii_masked", "intents", "table_chunks",
    "table_rows", "sections", "lexical_search", "search_reranked", "citations", "chunk_ids", "query_stats",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def plain(value):
    return repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    expected = sorted(tuple(plain(r[names.index(c)]) for c in df.columns) for r in cursor.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in df.collect()) == expected
    assert expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "item_id", "rank", "score", "same_label"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_top_rows_prune_before_the_shuffle(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    text = plan(ordinals.top_rows(df, ["g"], [F.col("id")], 2))
    assert "WindowGroupLimit" in text and "Partial" in text


def documents(spark, sf):
    # The raw scan: the spreading of small inputs is no part of the operators.
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_ingest_does_not_shuffle(spark, sf):
    docs = documents(spark, sf).selectExpr(
        "source AS university_id", "lang AS program", "'2024' AS year", "array(lang) AS aliases",
        "cast(doc_id AS string) AS source_file", "text",
    )
    for df in (
        chunking.build_chunks(docs),
        chunking.section_records(docs),
        embedding.embed(chunking.build_chunks(docs)),
        questions.analyse_questions(docs, "text"),
    ):
        assert "Exchange" not in plan(df)


def test_exploded_arrays_are_built_once(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    text = plan(chunking.chunk_tokens(docs))
    # An inferred emptiness test below the projection would repeat the tokenisation.
    assert len(re.findall(r"split\(", text)) == 1


def test_scans_read_only_what_is_used(spark, sf):
    text = plan(chunking.chunk_tokens(documents(spark, sf).select("doc_id", "text")))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_search_scores_items_where_they_lie(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    items = vectors.selectExpr("vec_id AS item_id", "embedding")
    queries = vectors.selectExpr("vec_id AS query_id", "embedding")
    text = plan(retrieval.knn_exact(items, queries, 3))
    assert "MapInArrow" in text and "Join" not in text
    cells = plan(retrieval.knn_exact(items, queries, 3, strategy="cells"))
    assert "CartesianProduct" not in cells and "NestedLoop" not in cells


def test_clustered_search_reads_the_probed_lists(spark, sf, tmp_path):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    index = retrieval.ivf_build(vectors.selectExpr("vec_id AS item_id", "embedding"), nlist=4)
    index.items.write.partitionBy("list_id").parquet(str(tmp_path / "index"))
    stored = retrieval.ClusterIndex(spark.read.parquet(str(tmp_path / "index")), index.centroids)
    one = vectors.filter("vec_id = 3").selectExpr("vec_id AS query_id", "embedding")
    found = retrieval.ivf_search(stored, one, 3, nprobe=1)
    assert re.search(r"PartitionFilters: \[[^\]]*list_id", plan(found))
    assert found.orderBy("rank").first()["item_id"] == 3


def test_hits_go_to_the_items(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    items = vectors.selectExpr("vec_id AS item_id", "embedding", "cast(label AS string) AS text", "label")
    queries = vectors.selectExpr("vec_id AS query_id", "embedding", "cast(label AS string) AS text")
    for df in (
        retrieval.search_sources({"chunk": items}, queries, 3),
        retrieval.knn_filtered(items, queries, {"label": 1}, 3, "post"),
    ):
        text = plan(df)
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
        # The only shuffles are those of top-k lists, by query.
        assert all("query_id" in line for line in text.split("\n") if "Exchange hashpartitioning" in line)


def test_no_plan_crosses_tables(spark, sf):
    for name in ("key_lookup", "chunk_overlaps", "documents_merged", "cascade_deleted", "query_stats", "running_histories"):
        text = plan(QUERIES[name](spark, sf))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_library_avoids_local_checkpoints_and_cross_joins():
    for path in (ROOT / "lectern").rglob("*.py"):
        source = path.read_text(encoding="utf-8")
        assert "localCheckpoint" not in source and "crossJoin" not in source, path


def test_entities_of_real_texts_equal_a_plain_pass(spark, sf):
    from lectern.functions import arrow

    want, counts = [], {}
    for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        for kind, patterns in arrow._entity_rules("default").items():
            found = sorted((m.start(), i, m.end(), m[0]) for i, (p, _, flags) in enumerate(patterns) for m in re.finditer(p, d.text or "", flags))
            last = -1
            for start, i, end, value in found:
                if start >= last:
                    last = end
                    want.append((d.doc_id, kind, patterns[i][1], value, start, end))
                    counts[d.doc_id] = counts.get(d.doc_id, 0) + 1
    got = QUERIES["entities_unicode"](spark, sf).select("doc_id", "type", "subtype", "value", "start", "end").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
    assert {r.doc_id: r.entity_count for r in QUERIES["entity_counts_unicode"](spark, sf).collect() if r.entity_count} == counts


def test_a_model_is_shipped_after_other_functions_ran(spark, tmp_path):
    text = "na\u00efve fa\u00e7ade &copy; two"
    spark.createDataFrame([(1, text, "fr", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    # A UDF that ran holds the driver's connection to the JVM, which can't be shipped.
    assert QUERIES["unicode_normalized"](spark, str(tmp_path)).count() == 1
    rows = {tuple(r) for r in QUERIES["texts_embedded_by_length"](spark, str(tmp_path)).collect()}
    assert rows == {tuple(r) for r in QUERIES["texts_embedded"](spark, str(tmp_path)).collect()} and rows
