"""Queries run as streams over a given table; their results equal the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.plans import search
from lectern.plans.registry import ORACLES, Inputs, query
from lectern.plans.text import plain_sql, windows_sql
from lectern.session import scratch_path
from lectern.sources import corpus, store
from lectern.streaming import jobs


def stream(t: Inputs, name: str):
    """The table as a stream of files, its rows spread over the cores (the test tables are one file each).

    A table is one file or a folder of files. A stream can't start from the path of a file, but from a pattern: the
    one here matches the table's name alone.
    """
    schema = getattr(t, name).schema
    rows = t.spark.readStream.schema(schema).parquet(f"{t.path}/{name}.parque[t]")
    return rows.repartition(t.spark.sparkContext.defaultParallelism)


def finish(query) -> None:
    """Waits until the available input is processed; a failure is raised here."""
    query.awaitTermination()


@query("stream_question_records", ORACLES["question_records"])
def stream_question_records(t: Inputs):
    analysed = jobs.question_stream(stream(t, "conversations").withColumnRenamed("text", "question"))
    out = scratch_path(t.spark, "questions")
    finish(
        analysed.writeStream.option("checkpointLocation", scratch_path(t.spark, "checkpoint"))
        .trigger(availableNow=True)
        .format("parquet")
        .start(out)
    )
    records = t.spark.read.parquet(out)
    return records.select(
        "conv_id",
        "turn",
        F.when(F.col("preprocessing.error").isNotNull(), "").otherwise(F.col("processed_question")).alias("processed_question"),
        "preprocessing.token_count",
        "preprocessing.language",
        "preprocessing.pii_masked",
        "intent",
        F.round("intent_confidence", 6).alias("intent_confidence"),
    )


@query(
    "stream_answers",
    search.HITS
    + "SELECT query_id, type, item_id, rank, round(s, 6) AS score, round(rerank_score, 6) AS rerank_score FROM hits",
)
def stream_answers(t: Inputs):
    questions = stream(t, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    out = scratch_path(t.spark, "hits")
    finish(jobs.answer_stream(questions, search.sources(t), out, scratch_path(t.spark, "checkpoint")))
    found = t.spark.read.parquet(out)
    return search.rounded(found, "score", "rerank_score").select(
        "query_id", "type", "item_id", "rank", "score", "rerank_score"
    )


# The first word of a file is the turn's name, so the first chunk of a file tells whose chunks they are.
_TURNS = f"""(SELECT name, {plain_sql("name || ' ' || text")} AS text, 'Université n° ' || length(text) % 5 AS university_id
  FROM (SELECT 'c' || conv_id || '_' || turn AS name, text FROM conversations))"""


@query("stream_ingest", windows_sql(512, 50, "name, university_id", _TURNS).replace("AS window_idx", "AS chunk_index"))
def stream_ingest(t: Inputs):
    """Files in folders with blanks and accents in their names, several deliveries, each file taken once."""
    path, out, checkpoint = (scratch_path(t.spark, n) for n in ("turns", "chunks", "checkpoint"))
    name = F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn")
    turns = t.conversations.select(
        F.concat(F.lit("Université n° "), F.length("text") % 5).alias("Universities"), F.concat(name, F.lit(" "), "text").alias("value"), "role"
    )
    # Two deliveries, ingested by one stream position: each file is taken once.
    for part in ("role = 'user'", "role <> 'user'"):
        store.write_texts(turns.filter(part).drop("role"), path, "Universities")
        folder = F.concat(F.lit("Universities/"), F.regexp_extract("path", "Universities=([^/]+)/", 1), F.lit("/"), corpus.file_name(F.col("path")))
        finish(jobs.ingest_stream(t.spark, path, out, checkpoint, "*.txt", key=folder))
    chunks = t.spark.read.parquet(out)
    names = chunks.filter("chunk_index = 0").select("source_file", F.regexp_extract("text", r"^(\S+)", 1).alias("name"))
    return chunks.join(names, "source_file").select(
        "name",
        F.regexp_extract("source_file", "Universities/([^/]+)/", 1).alias("university_id"),
        "chunk_index",
        F.col("text").alias("chunk"),
        X.token_count(F.col("text")).alias("n_tokens"),
    )


@query(
    "stream_query_stats",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS queries, round(avg(value), 6) AS mean
    FROM events GROUP BY ALL""",
)
def stream_query_stats(t: Inputs):
    out = scratch_path(t.spark, "stats")
    finish(jobs.query_stats_stream(stream(t, "events"), out, scratch_path(t.spark, "checkpoint")))
    windows = jobs.latest_windows(t.spark, out)
    return windows.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "queries", F.round("mean", 6).alias("mean")
    )


@query("windowed_query_stats", ORACLES["stream_query_stats"])
def windowed_query_stats(t: Inputs):
    """The batch form of the same windows."""
    windows = jobs.windowed_log(t.events.withColumn("ts", F.col("ts").cast("timestamp")))
    return windows.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "queries", F.round("mean", 6).alias("mean")
    )
