import random

import pytest
from lectern.operators import filters, postings, retrieval
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(400)], k=rng.randint(1, 80)))) for i in range(1500)]
    return spark.createDataFrame(rows + [(2000, None), (2001, ""), (2002, "W0 w0 w1 É")], "item_id long, text string").repartition(3)


def asked(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(420)], k=rng.randint(1, 6)))) for i in range(40)]
    return spark.createDataFrame(rows + [(90, None), (91, "unknown"), (92, "w0 W0 w1 é")], "query_id long, text string")


@pytest.mark.parametrize(("k", "size"), [(10, 16), (3, 256), (400, 7)])
def test_stored_lexical_search_equals_bm25(spark, texts, tmp_path, k, size):
    index = postings.postings_store(texts, str(tmp_path / "index"), block_postings=size)
    expected = sorted(map(tuple, retrieval.bm25(texts, asked(spark), k).select("query_id", "item_id", "score", "rank").collect()))
    found = sorted(map(tuple, postings.bm25_stored(index, asked(spark), k).select("query_id", "item_id", "score", "rank").collect()))
    assert [r[:2] + r[3:] for r in found] == [r[:2] + r[3:] for r in expected]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in expected], abs=2e-9)


def test_blocks_that_cannot_hold_a_hit_are_skipped(spark, texts, tmp_path):
    index = postings.postings_store(texts, str(tmp_path / "index"), block_postings=16)
    questions = spark.createDataFrame([(i, f"w{390 - i} w0 w1 w2") for i in range(20)], "query_id long, text string")
    counts = postings.blocks_read(index, questions, 2).first()
    assert 0 < counts["read_blocks"] < 0.5 * counts["all_blocks"], counts
    expected = sorted(map(tuple, retrieval.bm25(texts, questions, 2).select("query_id", "item_id", "rank").collect()))
    assert sorted(map(tuple, postings.bm25_stored(index, questions, 2).select("query_id", "item_id", "rank").collect())) == expected


def test_no_text_is_read(spark, texts, tmp_path):
    index = postings.postings_store(texts, str(tmp_path / "index"))
    plan = postings.bm25_stored(index, asked(spark))._jdf.queryExecution().toString()
    assert "ReadSchema" in plan and "items:array" in plan
    assert not any("text:string" in part.split(">")[0] for part in plan.split("ReadSchema: struct<")[1:])


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "item_id long, text string")
    index = postings.postings_store(none, str(tmp_path / "index"))
    assert postings.bm25_stored(index, asked(spark)).collect() == []


@pytest.mark.parametrize("text", ["w1 w2", "W10", "w1", "", "é", "w3 w3 w3", "nowhere at all", "w0 w0 w1 É", "%", "w_1"])
def test_stored_substring_search_equals_the_scan(spark, texts, tmp_path_factory, text):
    rows = texts.withColumnRenamed("item_id", "id")
    global _index
    if "_index" not in globals():
        _index = postings.trigram_store(rows, str(tmp_path_factory.mktemp("index") / "i"), slots=16)
    for limit in (10, None):
        found = postings.search_text_stored(_index, text, limit)
        assert found.columns == rows.columns or set(found.columns) == set(rows.columns)
        assert sorted(r.id for r in found.collect()) == sorted(r.id for r in filters.search_text(rows, text, limit).collect())


def test_only_slots_of_candidates_are_read(spark, texts, tmp_path):
    rows = texts.withColumnRenamed("item_id", "id").union(spark.createDataFrame([(5000, "a needle in here")], "id long, text string"))
    index = postings.trigram_store(rows, str(tmp_path / "index"), slots=16)
    found = postings.search_text_stored(index, "Needle")
    plan = found._jdf.queryExecution().toString()
    assert [r.id for r in found.collect()] == [5000]
    assert "PartitionFilters: [isnotnull(slot" in plan or "slot#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert postings.candidates(index, "needle").count() == 1


def test_trigrams_cover_all_code_points():
    assert postings.trigrams("ab").size == 0
    assert len(postings.trigrams("aaaa")) == 1
    assert len(set(postings.trigrams("\U0010ffffab\U0001f600cd").tolist())) == 4
    assert (postings.trigrams("\U0010ffff" * 3) > 0).all()
