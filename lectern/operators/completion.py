"""Batch completion with a pluggable function, and the whole answer job."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import fixed
from lectern.functions import text as X
from lectern.operators import context as ctx
from lectern.operators import retrieval
from lectern.session import scratch_path
from lectern.sources import versions
from lectern.sources.store import stored

ANSWERS = "digest string, model string, answer string"
ANSWER_PART = "answers-"


def map_items(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """Applies a per-batch callback to all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def complete(
    df: DataFrame,
    prompt: str,
    load: Callable[[], Callable[[list[str]], list[str | None]]] | None = None,
    fallback: Column | None = None,
    name: str = "completion",
    batch_size: int = 32,
    failed: str | None = None,
) -> DataFrame:
    """Adds the completion of a prompt column, the fallback where there is none.

    Each distinct prompt is completed once, however many rows share it; prompts are matched
    by a 256-bit digest, so the join moves digests and answers, not prompt texts. ``load``
    runs once per Python worker. When a call with several prompts fails, its prompts are
    asked one by one, so only those that fail alone are left to the fallback; ``failed`` names a
    column that tells which rows those are.
    """
    if fallback is None:
        fallback = X.first_sentence_summary(F.col(prompt))
    if load is None:
        done = df.withColumn(name, fallback)
        return done.withColumn(failed, F.lit(False)) if failed else done
    keyed = df.withColumn("_digest", F.sha2(F.col(prompt), 256))
    # A prompt that most rows share is one row on the right and is sent to every task if all
    # are few; otherwise adaptive execution splits the rows of such a prompt.
    joined = keyed.join(_asked(_distinct(keyed, prompt), load, batch_size), "_digest", "left")
    done = joined.withColumn(name, F.coalesce(F.nullif(F.trim("_answer"), F.lit("")), fallback))
    if failed:
        done = done.withColumn(failed, F.coalesce("_failed", F.lit(False)))
    return done.drop("_digest", "_answer", "_failed")


def _distinct(keyed: DataFrame, prompt: str) -> DataFrame:
    """(_digest, prompt), one row per distinct prompt."""
    return keyed.filter(F.col("_digest").isNotNull()).select("_digest", F.col(prompt).alias("prompt")).dropDuplicates(["_digest"])


def _asked(distinct: DataFrame, load, batch_size: int) -> DataFrame:
    """(_digest, _answer, _failed) of every prompt, from the model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            for low in range(0, len(batch), batch_size):
                part = batch.iloc[low : low + batch_size]
                answers = _answers(model, part["prompt"].tolist())
                yield pd.DataFrame(
                    {
                        "_digest": part["_digest"].tolist(),
                        "_answer": [a for a, _ in answers],
                        "_failed": [f for _, f in answers],
                    }
                )

    return distinct.mapInPandas(run, "_digest string, _answer string, _failed boolean")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(digest, model, answer) of the newest version of an answer store, empty before the first."""
    tables = versions.manifest(spark, path)["tables"]
    parts = [folder for name, folder in sorted(tables.items()) if name.startswith(ANSWER_PART)]
    return spark.read.schema(ANSWERS).parquet(*parts) if parts else spark.createDataFrame([], ANSWERS)


def complete_stored(
    df: DataFrame,
    prompt: str,
    load: Callable[[], Callable[[list[str]], list[str | None]]],
    path: str,
    model: str,
    fallback: Column | None = None,
    name: str = "completion",
    batch_size: int = 32,
    reused: str | None = None,
    parts: int = 16,
) -> DataFrame:
    """:func:`complete` with answers kept in a store, so that a model is asked for new prompts alone.

    Prompts are told apart by their digest and the name of the ``model`` (with its version and settings). Those without
    a stored answer are asked and published as one new version by one rename; a job that fails before leaves the store
    as it was. Failed calls are not stored, so the next job asks them again; empty answers are, and give the
    fallback. Two jobs that ask the same prompt at once may both store it; the smaller answer counts, in every later
    job. Answers stay in the folder they were written to; once a store has ``parts`` folders, the next load writes all into
    one. ``reused`` names a column that tells which rows got an answer that was there before. Null prompts get the fallback.
    """
    if fallback is None:
        fallback = X.first_sentence_summary(F.col(prompt))
    spark = df.sparkSession
    keyed = df.withColumn("_digest", F.sha2(F.col(prompt), 256))

    def known(answers: DataFrame) -> DataFrame:
        mine = answers.filter(F.col("model") == model)
        return mine.groupBy(F.col("digest").alias("_digest")).agg(F.min("answer").alias("_answer"))

    before = read_answers(spark, path)
    digests = before.filter(F.col("model") == model).select(F.col("digest").alias("_digest"))
    # Digests of the store meet digests of the table; no answer is read here, and prompts travel once.
    new = _distinct(keyed, prompt).join(digests, "_digest", "left_anti")
    asked = _asked(new, load, batch_size).filter(~F.col("_failed"))
    fresh = stored(
        asked.select(F.col("_digest").alias("digest"), F.lit(model).alias("model"), F.col("_answer").alias("answer")),
        scratch_path(spark, "answers"),
    )
    if not fresh.isEmpty():
        _publish(spark, path, fresh, parts)
    done = keyed.join(known(before.unionByName(fresh)), "_digest", "left")
    done = done.withColumn(name, F.coalesce(F.nullif(F.trim("_answer"), F.lit("")), fallback))
    if reused:
        old = digests.distinct().withColumn("_old", F.lit(True))
        done = done.join(old, "_digest", "left").withColumn(reused, F.coalesce("_old", F.lit(False))).drop("_old")
    return done.drop("_digest", "_answer")


def _publish(spark: SparkSession, path: str, fresh: DataFrame, parts: int) -> None:
    """Adds answers as one new part, or writes all parts into one where there are many."""

    def build(current: Mapping[str, DataFrame]) -> dict[str, DataFrame | None]:
        held = [n for n in current if n.startswith(ANSWER_PART)]
        if len(held) < parts:
            return {f"{ANSWER_PART}{uuid.uuid4().hex}": fresh}
        merged = read_answers(spark, path).unionByName(fresh).groupBy("digest", "model").agg(F.min("answer").alias("answer"))
        return {**dict.fromkeys(held), f"{ANSWER_PART}{uuid.uuid4().hex}": merged}

    versions.load(spark, path, uuid.uuid4().hex, build)


def _answers(model: Callable[[list[str]], list[str | None]], prompts: list[str]) -> list[tuple[str | None, bool]]:
    """(answer, failed) of each prompt; a failing call is repeated prompt by prompt."""
    try:
        return [(a, False) for a in model(prompts)]
    except Exception:
        return [(None, True)] if len(prompts) == 1 else [one for p in prompts for one in _answers(model, [p])]


def extractive_answer(context: Column) -> Column:
    """Summary of the first passage of a context: the answer when no model is given."""
    marker = f"\n{fixed.CONTEXT_RULE}\n"
    passage = F.get(F.split(context, marker, 3), F.lit(1))
    passage = F.get(F.split(F.coalesce(passage, context), f"\n\n{fixed.CONTEXT_SEPARATOR}\n\n", 2), F.lit(0))
    return X.first_sentence_summary(passage)


def answer_batch(
    questions: DataFrame,
    sources: Mapping[str, DataFrame],
    k: int = 5,
    load=None,
    scratch: str | None = None,
    attach: tuple[str, ...] = ("university_id", "program", "year", "source_file", "section_title"),
    **options,
) -> DataFrame:
    """(query_id, question, answer, num_sources, citations) for a table of encoded questions.

    Questions are ``(query_id, text, embedding)`` with optional ``question_type`` and
    ``language``. A question without hits keeps its row, with a fixed answer and no sources.
    The hits, which contexts and citations both read, are written to ``scratch``, by default a
    new folder below the session's shared one; the caller may remove it once the answers are read.
    """
    found = retrieval.search_and_rerank(sources, questions, k, attach=attach, **options)
    hits = stored(found, scratch or scratch_path(questions.sparkSession, "hits"))
    contexts = ctx.assemble_context(hits)
    cited = ctx.citations(hits, floor=0.0)
    per_query = cited.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("id", "source_file", "sections", "chunk_count", "score", "text"))).alias(
            "citations"
        )
    )
    kept = [c for c in ("question_type", "language") if c in questions.columns]
    asked = questions.select("query_id", F.col("text").alias("question"), *kept)
    joined = asked.join(contexts, "query_id", "left").join(per_query, "query_id", "left")
    found = ctx.build_prompts(joined.filter(F.col("context").isNotNull()))
    answered = complete(found, "prompt", load, extractive_answer(F.col("context")), "answer")
    columns = ["query_id", "question", "answer", "num_sources", "citations"]
    empty = joined.filter(F.col("context").isNull()).select(
        "query_id",
        "question",
        F.lit(fixed.NO_RESULT_ANSWER).alias("answer"),
        F.lit(0).cast("long").alias("num_sources"),
        F.col("citations"),
    )
    return answered.select(*columns).unionByName(empty)
