"""Question, ingest and query-log streams.

Every stream reuses the batch operators; checkpoints and results lie in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import chunking, embedding, questions, retrieval
from lectern.sources import corpus


def _start(stream: DataFrame, checkpoint: str, trigger: Mapping[str, object] | None):
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))


def question_stream(stream: DataFrame, column: str = "question", rules: str | dict = "default") -> DataFrame:
    """Question analysis on an unbounded source; stateless."""
    return questions.analyse_questions(stream, column, rules)


def answer_stream(
    stream: DataFrame,
    sources: Mapping[str, DataFrame],
    path: str,
    checkpoint: str,
    k: int = 5,
    key: str = "query_id",
    column: str = "question",
    trigger: Mapping[str, object] | None = None,
    **options,
) -> StreamingQuery:
    """Analyses, encodes and searches each micro-batch; hits land below ``path`` by batch.

    A batch is written to its own folder and overwritten when it is retried, so a restart
    neither loses nor repeats hits.
    """

    def search(batch: DataFrame, batch_id: int) -> None:
        asked = question_stream(batch, column).select(key, F.col("processed_question").alias("text"))
        encoded = embedding.embed(asked.withColumnRenamed(key, "query_id"), "text")
        hits = retrieval.search_and_rerank(sources, encoded, k, **options)
        hits.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(stream, checkpoint, trigger).foreachBatch(search).start()


def ingest_stream(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    glob: str = "*.md",
    key: Column | None = None,
    build: Callable[[DataFrame], DataFrame] = chunking.build_chunks,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Chunks of new files below ``path``, each file once.

    ``key`` names a file by an expression over ``path``; by default the file name does.
    """
    located = corpus.read_arrivals(spark, path, checkpoint, glob)
    if key is not None:
        located = located.withColumn("source_file", key)
    docs = corpus.derive_path_metadata(located).drop("path").withColumn("aliases", F.array().cast("array<string>"))
    return _start(build(docs), checkpoint, trigger).format("parquet").outputMode("append").start(out)


def windowed_log(log: DataFrame, window: str = "1 day", time: str = "ts", kind: str = "event_type", duration: str = "value") -> DataFrame:
    """(window_start, kind, queries, total): counts and summed durations per window; batch or stream."""
    return log.groupBy(F.window(time, window).alias("w"), F.col(kind)).agg(
        F.count(F.lit(1)).alias("queries"), F.sum(duration).alias("total")
    ).select(F.col("w.start").alias("window_start"), kind, "queries", (F.col("total") / F.col("queries")).alias("mean"))


def query_stats_stream(
    log: DataFrame,
    path: str,
    checkpoint: str,
    window: str = "1 day",
    delay: str = "1 hour",
    time: str = "ts",
    kind: str = "event_type",
    duration: str = "value",
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Windowed counts and means with a watermark; changed windows are written by batch.

    State is dropped once the watermark passes a window. Read the current value of each
    window with :func:`latest_windows`.
    """
    timed = log.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stats = windowed_log(timed, window, time, kind, duration)
    return _start(stats, checkpoint, trigger).outputMode("update").foreachBatch(write).start()


def latest_windows(spark: SparkSession, path: str, kind: str = "event_type") -> DataFrame:
    """The last written value of each window; aggregates before the shuffle."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in ("window_start", kind, "batch")]
    last = rows.groupBy("window_start", kind).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select("window_start", kind, "v.*")
