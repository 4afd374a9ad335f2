"""Ingest state, referential integrity, query log and statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.ordinals import top_rows

STATUSES = ("success", "failed", "skipped")


def _keys(df: DataFrame, on: str) -> DataFrame:
    """The distinct keys: repeated ones are dropped in each task, before the shuffle."""
    return df.select(on).distinct()


def unprocessed(files: DataFrame, chunks: DataFrame, on: str = "source_file") -> DataFrame:
    """Files that have no chunk yet."""
    return files.join(_keys(chunks, on), on, "left_anti")


def ingest_status(files: DataFrame, chunks: DataFrame, exists: Column, on: str = "source_file") -> DataFrame:
    """Adds ``status``: failed when the file is missing, skipped when it has chunks, else success."""
    done = chunks.groupBy(on).agg(F.lit(True).alias("_done"))
    return (
        files.join(done, on, "left")
        .withColumn(
            "status", F.when(~exists, "failed").when(F.col("_done"), "skipped").otherwise("success")
        )
        .drop("_done")
    )


def ingest_summary(results: DataFrame) -> DataFrame:
    """One row: total, success, failed, skipped."""
    return results.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    )


def merge_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing documents and the incoming ones whose source file is new.

    Several incoming rows of one file count as one document, the first by path.
    """
    fresh = incoming.join(_keys(existing, "source_file"), "source_file", "left_anti")
    values = [c for c in fresh.columns if c != "source_file"]
    first = fresh.groupBy("source_file").agg(F.min_by(F.struct(*values), F.struct(*[F.col(v) for v in values])).alias("_d"))
    return existing.unionByName(first.select("source_file", "_d.*").select(*existing.columns))


def merge_chunks(existing: DataFrame, incoming: DataFrame, on: str = "source_file") -> DataFrame:
    """Chunks are added only to documents that have none."""
    return existing.unionByName(incoming.join(_keys(existing, on), on, "left_anti").select(*existing.columns))


def with_chunk_counts(documents: DataFrame, chunks: DataFrame, on: str = "source_file") -> DataFrame:
    """Adds ``num_chunks``; counts are aggregated per task before the shuffle."""
    counts = chunks.groupBy(on).agg(F.count(F.lit(1)).alias("num_chunks"))
    return documents.drop("num_chunks").join(counts, on, "left").withColumn(
        "num_chunks", F.coalesce("num_chunks", F.lit(0).cast("long"))
    )


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str | None = None) -> DataFrame:
    """Child rows whose parent does not exist; rows without a key are none."""
    keys = _keys(parent.select(F.col(pk or fk).alias(fk)), fk)
    return child.filter(F.col(fk).isNotNull()).join(keys, fk, "left_anti")


def cascade_delete(
    tables: Mapping[str, DataFrame], root: str, doomed: DataFrame, edges: Mapping[str, tuple[str, str, str]], pk: str
) -> dict[str, DataFrame]:
    """Deletes root rows and, table by table, the rows that refer to deleted ones.

    ``edges`` maps child -> (parent table, foreign key, parent key), parents before children.
    """
    kept = dict(tables)
    gone = {root: tables[root].join(doomed.select(pk), pk, "left_semi")}
    kept[root] = tables[root].join(doomed.select(pk), pk, "left_anti")
    for child, (parent, fk, key) in edges.items():
        if parent not in gone:
            continue
        lost = _keys(gone[parent].select(F.col(key).alias(fk)), fk)
        gone[child] = tables[child].join(lost, fk, "left_semi")
        kept[child] = tables[child].join(lost, fk, "left_anti")
    return kept


def log_rows(answers: DataFrame, llm_model: str = "mistral", embedding_model: str = "BAAI/bge-m3") -> DataFrame:
    """Query-log rows with defaults for absent columns."""
    defaults = {
        "user_id": F.lit(None).cast("long"),
        "question_type": F.lit("qa"),
        "response_time_ms": F.lit(0),
        "llm_model": F.lit(llm_model),
        "embedding_model": F.lit(embedding_model),
        "metadata_filters": F.lit("{}"),
    }
    columns = []
    for name, default in defaults.items():
        columns.append((F.coalesce(F.col(name), default) if name in answers.columns else default).alias(name))
    stamp = F.col("timestamp") if "timestamp" in answers.columns else F.current_timestamp().alias("timestamp")
    return answers.select("question", "answer", "num_sources", *columns, stamp)


def log_queries(answers: DataFrame, path: str, **defaults: str) -> None:
    log_rows(answers, **defaults).write.mode("append").parquet(path)


def recent_queries(log: DataFrame, n: int = 100, user: object | None = None, time: str = "timestamp", tie: str = "id") -> DataFrame:
    """The latest n queries, of one user or of all: a top-n per task, merged."""
    rows = log if user is None else log.filter(F.col("user_id") == user)
    return rows.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(n)


def recent_per_user(log: DataFrame, n: int, time: str = "timestamp", tie: str = "id") -> DataFrame:
    """Each user's latest n queries."""
    return top_rows(log, ["user_id"], [F.col(time).desc(), F.col(tie).desc()], n)


def _per_group(df: DataFrame, by: str, statistic: str) -> DataFrame:
    counted = df.groupBy(F.col(by).cast("string").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return counted.select(F.lit(statistic).alias("statistic"), "key", "value")


def _totals(df: DataFrame, **aggregates: Column) -> DataFrame:
    """One row per named aggregate of the whole table; an empty table has them as well."""
    row = df.agg(*[column.cast("double").alias(name) for name, column in aggregates.items()])
    long = row.unpivot([], list(aggregates), "statistic", "value")
    return long.select("statistic", F.lit(None).cast("string").alias("key"), "value")


def query_stats(log: DataFrame, duration: str = "response_time_ms", kind: str = "question_type") -> DataFrame:
    """(statistic, key, value): total_queries, avg_response_time_ms and question_types per type.

    The mean is rounded to two decimals and 0 for an empty log.
    """
    totals = _totals(
        log,
        total_queries=F.count(F.lit(1)),
        avg_response_time_ms=F.round(F.coalesce(F.avg(duration), F.lit(0.0)), 2),
    )
    return totals.unionByName(_per_group(log, kind, "question_types"))


def document_stats(docs: DataFrame, chunks: DataFrame, by: str = "university_id") -> DataFrame:
    """(statistic, key, value): total_documents, total_chunks and documents_by_university."""
    return (
        _totals(docs, total_documents=F.count(F.lit(1)))
        .unionByName(_totals(chunks, total_chunks=F.count(F.lit(1))))
        .unionByName(_per_group(docs, by, "documents_by_university"))
    )


def chunk_report(retrieved: DataFrame) -> DataFrame:
    """Hits, mean rank and mean scores per retrieved chunk."""
    scores = [c for c in ("vector_score", "bm25_score", "combined_score", "rerank_score") if c in retrieved.columns]
    return retrieved.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("hits"),
        F.avg("rank").alias("mean_rank"),
        *[F.avg(c).alias(f"mean_{c}") for c in scores],
    )


def feedback_report(log: DataFrame, feedback: DataFrame, key: str = "query_id") -> DataFrame:
    """Queries, rated queries, mean rating and helpful rate per question type."""
    joined = log.select(key, "question_type").join(feedback.select(key, "rating", "helpful"), key, "left")
    return joined.groupBy("question_type").agg(
        F.count(F.lit(1)).alias("queries"),
        F.count("rating").alias("rated"),
        F.avg("rating").alias("mean_rating"),
        F.avg(F.col("helpful").cast("int")).alias("helpful_rate"),
    )
