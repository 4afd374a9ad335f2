"""A key that holds a third of all rows is split over tasks, and results stay right."""

import pytest
from lectern.operators import completion, embedding, filters
from pyspark.sql import functions as F

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.fixture
def split(spark):
    """A session whose adaptive execution takes small partitions for skewed, and never broadcasts by itself."""
    old = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500 + 1000)
    return spark.range(30_000, numPartitions=16).select(key.alias("k"), "id", F.sha2(F.col("id").cast("string"), 256).alias("text"))


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sent", [0, 10])
def test_lookup_of_a_hot_key(split, monkeypatch, sent):
    monkeypatch.setattr(filters, "SENT_KEYS", sent)
    found = filters.lookup(rows(split), split.createDataFrame([(7,), (1001,), (-1,)], "k long"), "k")
    plan = executed(found)
    # Keys are sent, or the hot key is split.
    assert ("BroadcastHashJoin" in plan and "SortMergeJoin" not in plan) if sent else "skew=true" in plan
    assert {(r["k"], r["matches"], r["n"]) for r in found.groupBy("k", "matches").agg(F.count("id").alias("n")).collect()} == {(7, 10_000, 10_000), (1001, 40, 40)}


def test_metadata_attached_to_a_hot_key(split):
    meta = split.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("m"), F.lit(1).alias("o"))
    found = filters.attach_by_key(rows(split), meta.union(meta.selectExpr("k", "m + 1", "2")), "k", "o")
    assert "skew=true" in executed(found)
    assert found.filter("m <> 2 * k + 1 OR m IS NULL").count() == 0 and found.count() == 30_000


def test_a_prompt_shared_by_a_third_of_the_rows(split):
    prompts = rows(split).select("id", F.concat(F.lit("p"), "k").alias("p"), "text")
    done = completion.complete(prompts, "p", lambda: lambda asked: [a + "!" for a in asked])
    assert "skew=true" in executed(done)
    assert done.filter("completion <> p || '!'").count() == 0


def test_a_section_title_shared_by_many_documents(split, monkeypatch):
    monkeypatch.setattr(embedding, "SENT_TITLES", 0)
    title = F.when(F.col("id") % 3 == 0, "Unknown").otherwise(F.concat(F.lit("t"), F.col("id") % 50))
    chunks = split.range(9000, numPartitions=8).select(
        title.alias("section_title"), F.col("id").alias("source_file"), F.lit(0).alias("chunk_index"), F.sha2(F.col("id").cast("string"), 512).alias("summary")
    )
    found = embedding.section_summaries(chunks, by="title")
    assert "skew=true" in executed(found)
    last = found.groupBy("section_title", "section_id").agg(F.max("part_order").alias("last"), F.count("part").alias("n"), F.max("num_chunks").alias("c"))
    assert last.filter("last <> n OR n <> c").count() == 0 and last.filter("section_title = 'Unknown'").first()["n"] == 3000
