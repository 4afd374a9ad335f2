"""Queries over filters, lookups, metadata, ingest state, logs and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import chunking, ingest, postings, retrieval
from lectern.operators import filters as flt
from lectern.plans.registry import Inputs, query
from lectern.plans.text import WINDOWS
from lectern.session import scratch_path
from lectern.sources import versions


def documents(t: Inputs):
    """Documents under the names of the relational store."""
    return t.documents.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_file"),
        F.col("source").alias("university_id"),
        F.col("lang").alias("program"),
        F.when(F.col("n_chars") >= 1000, "2024").otherwise("2023").alias("year"),
        "text",
    )


DOCS = """(SELECT doc_id AS id, 'd' || doc_id || '.md' AS source_file, source AS university_id, lang AS program,
  CASE WHEN n_chars >= 1000 THEN '2024' ELSE '2023' END AS year, text FROM documents)"""


# ---- filters and lookups --------------------------------------------------------------


@query(
    "metadata_filtered",
    f"SELECT id, university_id, program FROM {DOCS} WHERE program = 'fr' AND year = '2024'",
)
def metadata_filtered(t: Inputs):
    nested = documents(t).select(
        "id", "university_id", "program", F.struct("university_id", "program", "year").alias("metadata")
    )
    # A field that does not exist equals only None.
    kept = flt.filter_metadata(nested, {"metadata.program": "fr", "year": "2024", "campus": None})
    return kept.select("id", "university_id", "program")


@query(
    "documents_filtered",
    f"SELECT id, source_file FROM {DOCS} WHERE university_id = 'src3' AND program = 'en'",
)
def documents_filtered(t: Inputs):
    return flt.filter_documents(documents(t), university_id="src3", program="en", year="").select("id", "source_file")


@query("text_search", f"SELECT id FROM {DOCS} WHERE contains(lower(text), 'tion the') ORDER BY id LIMIT 10")
def text_search(t: Inputs):
    return flt.search_text(documents(t), "Tion The").select("id")


@query("text_search_stored", f"SELECT id FROM {DOCS} WHERE contains(lower(text), 'tion the') ORDER BY id LIMIT 10")
def text_search_stored(t: Inputs):
    """The same search over stored trigrams: only rows that can match are read."""
    index = postings.trigram_store(documents(t), scratch_path(t.spark, "trigrams"))
    return postings.search_text_stored(index, "Tion The").select("id")


@query("text_search_wildcard", f"SELECT id FROM {DOCS} WHERE text ILIKE '%tion_the%' ORDER BY id LIMIT 10")
def text_search_wildcard(t: Inputs):
    return flt.search_text(documents(t), "tion_the", literal=False).select("id")


@query(
    "key_lookup",
    """SELECT o_orderkey, o_custkey, matches FROM orders JOIN (
      SELECT o_custkey, count(*) AS matches FROM orders WHERE o_custkey IN (
        SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY o_custkey) USING (o_custkey)""",
)
def key_lookup(t: Inputs):
    keys = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return flt.lookup(t.orders.select("o_orderkey", "o_custkey"), keys, "o_custkey")


@query(
    "key_lookup_duplicates",
    """SELECT o_custkey, count(*) AS matches FROM orders JOIN customer ON c_custkey = o_custkey
    GROUP BY o_custkey HAVING count(*) > 1""",
)
def key_lookup_duplicates(t: Inputs):
    keys = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    return flt.lookup_duplicates(t.orders, keys, "o_custkey")


@query(
    "chunks_in_order",
    f"""SELECT doc_id AS document_id, window_idx AS chunk_index, chunk AS text FROM ({WINDOWS})
    WHERE doc_id IN (SELECT doc_id FROM labels) ORDER BY doc_id, window_idx""",
)
def chunks_in_order(t: Inputs):
    chunks = chunking.chunk_tokens(t.documents.select(F.col("doc_id").alias("document_id"), "text"))
    named = chunks.select("document_id", F.col("window_idx").alias("chunk_index"), F.col("chunk").alias("text"))
    return flt.chunks_of(named, t.labels.select(F.col("doc_id").alias("document_id")))


@query(
    "metadata_attached",
    """SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN (
      SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice
      FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
)
def metadata_attached(t: Inputs):
    meta = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return flt.attach_by_key(t.customer.select("c_custkey", "c_name"), meta, "c_custkey", "o_orderkey")


@query(
    "metadata_normalized",
    f"""SELECT id, university_id, '' AS program, CASE WHEN year = '2024' THEN year ELSE '' END AS year,
      program AS aliases, source_file, 'unknown' AS chunk_type FROM {DOCS}""",
)
def metadata_normalized(t: Inputs):
    raw = documents(t).select(
        "id",
        F.struct(
            "university_id",
            F.when(F.col("year") == "2024", F.col("year")).alias("year"),
            F.col("program").alias("aliases"),  # scalar
            "source_file",
        ).alias("metadata"),
    )
    return flt.normalize_metadata(raw).withColumn("aliases", F.array_join("aliases", ","))


@query(
    "metadata_merged",
    """SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE lang END AS lang, source, quality
    FROM documents d LEFT JOIN labels USING (doc_id)""",
)
def metadata_merged(t: Inputs):
    base = t.documents.select("doc_id", "lang", "source")
    override = t.labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("lang"), "quality")
    return flt.merge_metadata(base, override, "doc_id")


@query(
    "metadata_maps_merged",
    """SELECT doc_id, 'lang' AS key, lang AS value FROM documents UNION ALL
    SELECT doc_id, 'source', CASE WHEN quality = 1 THEN 'good' ELSE source END FROM documents LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT doc_id, 'toxic', toxic::VARCHAR FROM documents JOIN labels USING (doc_id)""",
)
def metadata_maps_merged(t: Inputs):
    joined = t.documents.join(t.labels, "doc_id", "left")
    base = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    override = F.when(
        F.col("quality").isNotNull(),
        F.create_map(
            F.lit("source"), F.when(F.col("quality") == 1, "good"), F.lit("toxic"), F.col("toxic").cast("string")
        ),
    )
    return joined.select("doc_id", F.explode(flt.merge_maps(base, override)).alias("key", "value"))


@query(
    "metadata_validated",
    """SELECT doc_id, CASE WHEN quality IS NULL THEN 'program' ELSE '' END
      || CASE WHEN quality IS NULL AND n_chars < 500 THEN ',' ELSE '' END
      || CASE WHEN n_chars < 500 THEN 'year' ELSE '' END AS missing, quality IS NOT NULL AND n_chars >= 500 AS valid
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def metadata_validated(t: Inputs):
    rows = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id",
        F.col("source").alias("university_id"),
        F.col("quality").cast("string").alias("program"),
        F.when(F.col("n_chars") >= 500, "2024").alias("year"),
        F.lit("paragraph").alias("chunk_type"),
    )
    return flt.validate_metadata(rows).select("doc_id", F.array_join("missing", ",").alias("missing"), "valid")


@query(
    "embeddings_validated",
    """SELECT vec_id, CASE label WHEN 3 THEN 'dimension' WHEN 4 THEN 'not finite' WHEN 5 THEN 'missing' END AS reason
    FROM embeddings""",
)
def embeddings_validated(t: Inputs):
    # Three labels are damaged, one per kind of fault.
    vector = F.col("embedding")
    damaged = (
        F.when(F.col("label") == 3, F.slice(vector, 1, 10))
        .when(F.col("label") == 4, F.transform(vector, lambda x, i: F.when(i == 7, F.lit(float("nan"))).otherwise(x)))
        .when(F.col("label") != 5, vector)
    )
    rows = t.embeddings.select("vec_id", damaged.alias("embedding"))
    return flt.validate_embeddings(rows).select("vec_id", "reason")


# ---- list helpers --------------------------------------------------------------------------


@query(
    "first_per_key",
    """SELECT user_id, event_type, event_id, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1""",
)
def first_per_key(t: Inputs):
    rows = t.events.select("user_id", "event_type", "event_id", "value")
    return retrieval.dedup_first(rows, ["user_id", "event_type"], ["event_id"])


@query(
    "batches",
    "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 100)::BIGINT AS batch FROM orders",
)
def batches(t: Inputs):
    return retrieval.assign_batches(t.orders.select("o_orderkey"), 100, ["o_orderkey"])


@query(
    "batches_per_status",
    """SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 100)::BIGINT
      AS batch FROM orders""",
)
def batches_per_status(t: Inputs):
    return retrieval.assign_batches(
        t.orders.select("o_orderkey", "o_orderstatus"), 100, ["o_orderkey"], ["o_orderstatus"]
    )


# ---- ingest state ----------------------------------------------------------------------------


@query("files_unprocessed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def files_unprocessed(t: Inputs):
    return ingest.unprocessed(t.documents.select("doc_id"), t.labels, "doc_id")


@query(
    "ingest_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE n_chars >= 100 AND quality IS NULL) AS success,
      count(*) FILTER (WHERE n_chars < 100) AS failed, count(*) FILTER (WHERE n_chars >= 100 AND quality IS NOT NULL) AS skipped
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def ingest_summary(t: Inputs):
    files = t.documents.select("doc_id", "n_chars")
    return ingest.ingest_summary(ingest.ingest_status(files, t.labels, F.col("n_chars") >= 100, "doc_id"))


def _store(t: Inputs):
    """(stored, incoming): labelled documents are stored already, incoming files name their document twice."""
    named = t.documents.select(F.concat(F.lit("d"), F.col("doc_id")).alias("source_file"), "doc_id", "lang")
    stored = named.join(t.labels.select("doc_id"), "doc_id", "left_semi").select(
        "source_file", F.lit("stored").alias("path"), "lang"
    )
    places = F.explode(F.array(F.lit("a"), F.lit("b")))
    return stored, named.select("source_file", places.alias("path"), "lang")


@query(
    "documents_merged",
    """SELECT 'd' || doc_id AS source_file, CASE WHEN quality IS NULL THEN 'a' ELSE 'stored' END AS path, lang
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def documents_merged(t: Inputs):
    return ingest.merge_documents(*_store(t))


@query(
    "chunks_merged",
    f"""SELECT 'd' || doc_id AS source_file, CASE WHEN quality IS NULL THEN window_idx ELSE -1 END AS chunk_index
    FROM documents LEFT JOIN labels USING (doc_id) JOIN ({WINDOWS}) USING (doc_id)
    WHERE quality IS NULL OR window_idx = 0""",
)
def chunks_merged(t: Inputs):
    key = F.concat(F.lit("d"), F.col("doc_id")).alias("source_file")
    chunks = chunking.chunk_tokens(t.documents.select("doc_id", "text")).select("doc_id", "window_idx")
    labelled = t.labels.join(chunks.filter("window_idx = 0"), "doc_id", "left_semi")
    existing = labelled.select(key, F.lit(-1).alias("chunk_index"))
    return ingest.merge_chunks(existing, chunks.select(key, F.col("window_idx").alias("chunk_index")))


@query(
    "documents_loaded",
    f"""SELECT 'd' || doc_id AS source_file, lang, n AS num_chunks FROM documents
    JOIN (SELECT doc_id, count(*) AS n FROM ({WINDOWS}) GROUP BY doc_id) USING (doc_id)""",
)
def documents_loaded(t: Inputs):
    """Two loads, the labelled documents and then all, of which the first is repeated; chunks are counted in the last version."""
    path = scratch_path(t.spark, "versions")
    key = F.concat(F.lit("d"), F.col("doc_id")).alias("source_file")
    chunks = chunking.chunk_tokens(t.documents.select("doc_id", "text")).select(key, "window_idx")
    first = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi").select(key, "lang")
    for load_id, given in (("labelled", first), ("labelled", first), ("all", t.documents.select(key, "lang"))):
        versions.load_documents(t.spark, path, load_id, given, chunks)
    found = versions.read_version(t.spark, path)
    return ingest.with_chunk_counts(found["documents"], found["chunks"]).filter("num_chunks > 0").select("source_file", "lang", "num_chunks")


@query(
    "chunk_counts",
    f"""SELECT doc_id, coalesce(n, 0)::BIGINT AS num_chunks FROM documents
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({WINDOWS}) GROUP BY doc_id) USING (doc_id)""",
)
def chunk_counts(t: Inputs):
    chunks = chunking.chunk_tokens(t.documents.select("doc_id", "text")).select("doc_id")
    return ingest.with_chunk_counts(t.documents.select("doc_id"), chunks, "doc_id")


@query(
    "orphans",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN ("
    "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')",
)
def orphans(t: Inputs):
    parents = t.orders.filter("o_orderstatus <> 'P'")
    return ingest.orphans(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), parents, "l_orderkey", "o_orderkey")


@query(
    "cascade_deleted",
    """WITH keep AS (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'),
      orders_left AS (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (
        SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')),
      lines_left AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (
        SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')))
    SELECT 'customer' AS name, count(*) AS rows_left FROM keep UNION ALL
    SELECT 'orders', count(*) FROM orders_left UNION ALL SELECT 'lineitem', count(*) FROM lines_left""",
)
def cascade_deleted(t: Inputs):
    kept = ingest.cascade_delete(
        {
            "customer": t.customer.select("c_custkey"),
            "orders": t.orders.select("o_orderkey", "o_custkey"),
            "lineitem": t.lineitem.select("l_orderkey"),
        },
        "customer",
        t.customer.filter("c_mktsegment = 'BUILDING'"),
        {"orders": ("customer", "o_custkey", "c_custkey"), "lineitem": ("orders", "l_orderkey", "o_orderkey")},
        "c_custkey",
    )
    result = None
    for name, df in kept.items():
        row = df.agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(name).alias("name"), "rows_left")
        result = row if result is None else result.unionByName(row)
    return result


# ---- query log ---------------------------------------------------------------------------------


def event_log(t: Inputs):
    return t.events.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("event_type").alias("question_type"),
        F.col("value").alias("response_time_ms"),
        F.col("ts").alias("timestamp"),
    )


@query(
    "queries_logged",
    """SELECT a.text AS question, b.text AS answer, a.turn AS num_sources, NULL::BIGINT AS user_id, 'qa' AS question_type,
      0 AS response_time_ms, 'mistral' AS llm_model FROM conversations a JOIN conversations b
      ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
)
def queries_logged(t: Inputs):
    asked = t.conversations.select("conv_id", "turn", "role", F.col("text").alias("question"))
    replies = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    answers = asked.join(replies, ["conv_id", "turn"]).withColumnRenamed("turn", "num_sources")
    path = scratch_path(t.spark, "query-log")
    # Two appends: the log grows by both.
    ingest.log_queries(answers.filter("role = 'user'"), path)
    ingest.log_queries(answers.filter("role <> 'user'"), path)
    return t.spark.read.parquet(path).select(
        "question", "answer", "num_sources", "user_id", "question_type", "response_time_ms", "llm_model"
    )


@query("queries_recent", "SELECT event_id AS id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def queries_recent(t: Inputs):
    return ingest.recent_queries(event_log(t), 100).select("id", "user_id")


@query(
    "queries_recent_per_user",
    """SELECT id, user_id, rank::INT AS rank FROM (SELECT event_id AS id, user_id,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 5""",
)
def queries_recent_per_user(t: Inputs):
    return ingest.recent_per_user(event_log(t), 5).select("id", "user_id", "rank")


@query(
    "query_stats",
    """SELECT 'question_types' AS statistic, event_type AS key, count(*)::DOUBLE AS value FROM events GROUP BY event_type
    UNION ALL SELECT 'total_queries', NULL, count(*) FROM events
    UNION ALL SELECT 'avg_response_time_ms', NULL, round(avg(value), 2) FROM events""",
)
def query_stats(t: Inputs):
    return ingest.query_stats(event_log(t))


@query(
    "document_stats",
    f"""SELECT 'documents_by_university' AS statistic, university_id AS key, count(*)::DOUBLE AS value FROM {DOCS}
    GROUP BY university_id UNION ALL SELECT 'total_documents', NULL, count(*) FROM documents
    UNION ALL SELECT 'total_chunks', NULL, count(*) FROM ({WINDOWS})""",
)
def document_stats(t: Inputs):
    chunks = chunking.chunk_tokens(t.documents.select("doc_id", "text")).select("doc_id")
    return ingest.document_stats(documents(t), chunks)


@query(
    "feedback_report",
    """SELECT event_type AS question_type, count(*) AS queries, count(quality) AS rated,
      round(avg(1 + 4 * quality), 6) AS mean_rating, round(avg(1 - toxic), 6) AS helpful_rate
    FROM events LEFT JOIN labels ON doc_id = event_id GROUP BY event_type""",
)
def feedback_report(t: Inputs):
    log = event_log(t).withColumnRenamed("id", "query_id")
    feedback = t.labels.select(
        F.col("doc_id").alias("query_id"), (1 + 4 * F.col("quality")).alias("rating"), (F.col("toxic") == 0).alias("helpful")
    )
    report = ingest.feedback_report(log, feedback)
    return report.withColumns(
        {"mean_rating": F.round("mean_rating", 6), "helpful_rate": F.round("helpful_rate", 6)}
    )
