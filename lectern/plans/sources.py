"""Queries over sources and sinks: each writes a given table below the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import chunking
from lectern.plans.registry import Inputs, query
from lectern.plans.text import CHUNKS, corpus
from lectern.session import scratch_path
from lectern.sources import corpus as files
from lectern.sources import store


# Folders that hold the files, and envelopes or manifest entries of one file.
FOLDERS, PER_FILE = 16, 100


def write_files(t: Inputs, rows, key: str, text: str) -> str:
    """One text file per row, its key in the first line, in a fixed number of folders."""
    path = scratch_path(t.spark, "files")
    named = rows.select(
        F.pmod(F.xxhash64(key), F.lit(FOLDERS)).alias("folder"), F.concat(F.col(key).cast("string"), F.lit("\n"), F.col(text)).alias("value")
    )
    store.write_texts(named, path, "folder")
    return path


def read_pages(t: Inputs, path: str):
    found = files.read_markdown(t.spark, path, "*.txt")
    page = F.regexp_extract("text", r"\A(\d+)\n", 1).cast("long")
    return found.withColumn("page_id", page).withColumn("text", F.regexp_extract("text", r"(?s)\A\d+\n(.*)\n\z", 1))


@query("files_scanned", "SELECT page_id, html AS text FROM pages")
def files_scanned(t: Inputs):
    return read_pages(t, write_files(t, t.pages, "page_id", "html")).select("page_id", "text")


@query(
    "manifest_applied",
    """SELECT page_id, true AS found, 'U' || page_id % 7 AS university_id, 'en' AS alias, html AS text FROM pages
    UNION ALL SELECT page_id, false, 'none', 'gone', NULL FROM pages""",
)
def manifest_applied(t: Inputs):
    path = write_files(t, t.pages, "page_id", "html")
    pages = read_pages(t, path)
    entry = lambda file, univ, alias: F.struct(
        file.alias("file"),
        univ.alias("university_id"),
        F.col("page_id").cast("string").alias("program"),
        F.lit("2024").alias("year"),
        F.array(alias).alias("aliases"),
    )
    here = F.regexp_extract("path", r"(folder=\d+/.*)$", 1)
    entries = F.array(
        entry(here, F.concat(F.lit("U"), F.col("page_id") % 7), F.lit("en")),
        entry(F.concat(F.lit("gone/"), F.col("page_id"), F.lit(".md")), F.lit("none"), F.lit("gone")),
    )
    manifests = pages.groupBy(F.floor(F.col("page_id") / PER_FILE).alias("n")).agg(F.flatten(F.collect_list(entries)).alias("files"))
    where = scratch_path(t.spark, "manifests")
    manifests.select("files").write.option("maxRecordsPerFile", 1).json(where)
    applied = files.apply_manifest(pages, files.read_manifest(t.spark, where), path)
    return applied.select(
        F.col("program").cast("long").alias("page_id"), "found", "university_id", F.get("aliases", F.lit(0)).alias("alias"), "text"
    )


@query(
    "path_metadata",
    """SELECT page_id, CASE WHEN url LIKE 'https:%' THEN split_part(split_part(url, '//', 2), '/', 2) ELSE 'UNKNOWN' END AS university_id,
      CASE WHEN contains(url, '?') THEN 'queried' ELSE 'General' END AS program, '2024' AS year FROM pages""",
)
def path_metadata(t: Inputs):
    rest = F.regexp_extract("url", r"^https?://[^/]+/(.*)$", 1)
    rows = t.pages.select(
        "page_id",
        F.when(F.startswith("url", F.lit("https:")), F.concat(F.lit("data/raw/Universities/"), rest)).otherwise(
            F.concat(F.lit("data/other/"), rest)
        ).alias("path"),
        F.when(F.contains("url", F.lit("?")), "queried").otherwise("").alias("program"),
    )
    return files.derive_path_metadata(rows).drop("path")


@query(
    "jsonl_round_trip",
    "SELECT doc_id, text, lang, CASE WHEN n_chars > 1000 THEN source END AS source FROM documents",
)
def jsonl_round_trip(t: Inputs):
    path = scratch_path(t.spark, "jsonl")
    rows = t.documents.select("doc_id", "text", "lang", F.when(F.col("n_chars") > 1000, F.col("source")).alias("source"))
    store.write_jsonl(rows, path)
    return store.read_jsonl(t.spark, path, rows.schema)


@query(
    "envelopes_read",
    """SELECT page_id, 'chunk' AS kind, url AS text, '-' AS table_format FROM pages UNION ALL
    SELECT page_id, 'table', html, CASE WHEN url LIKE 'https:%' THEN 'standard' ELSE 'advanced' END FROM pages""",
)
def envelopes_read(t: Inputs):
    secure = F.startswith("url", F.lit("https:"))
    key = F.col("page_id").cast("string")
    chunk = F.struct(key.alias("chunk_id"), F.col("url").alias("text"), F.struct(key.alias("source_file")).alias("metadata"))
    kind = F.when(secure, "table_row").otherwise("table_chunk")
    table = F.struct(
        key.alias("row_id"),
        F.when(secure, F.col("html")).alias("text_fallback"),
        F.when(secure, "before").alias("context_paragraph"),
        F.when(~secure, F.col("html")).alias("text"),
        F.struct(key.alias("source_file"), kind.alias("chunk_type")).alias("metadata"),
    )
    # An envelope is of one table format.
    envelopes = t.pages.groupBy(F.floor(F.col("page_id") / PER_FILE).alias("n"), secure.alias("secure")).agg(
        F.collect_list(chunk).alias("chunks"),
        F.collect_list(table).alias("table_rows"),
        F.count(F.lit(1)).alias("total_chunks"),
        F.count(F.lit(1)).alias("total_table_rows"),
    )
    path = scratch_path(t.spark, "envelopes")
    envelopes.drop("n", "secure").write.option("maxRecordsPerFile", 1).json(path)
    chunks, tables = store.read_envelope(t.spark, path)
    page = F.col("metadata.source_file").cast("long").alias("page_id")
    return chunks.select(page, F.lit("chunk").alias("kind"), "text", F.lit("-").alias("table_format")).unionByName(
        tables.select(page, F.lit("table").alias("kind"), F.coalesce("text_fallback", "text").alias("text"), "table_format")
    )


@query(
    "etl_written",
    f"""SELECT chunk_id AS key, text AS value FROM ({CHUNKS})
    UNION ALL SELECT 'total_chunks', count(*)::VARCHAR FROM ({CHUNKS})
    UNION ALL SELECT 'total_table_rows', count(*)::VARCHAR FROM conversations""",
)
def etl_written(t: Inputs):
    chunks = chunking.build_chunks(corpus(t))
    tables = t.conversations.select(F.col("text"), F.col("conv_id").cast("string").alias("source_file"))
    path = scratch_path(t.spark, "etl")
    store.write_etl(chunks, tables, path)
    written, _ = store.read_etl(t.spark, path)
    totals = t.spark.read.schema("total_chunks long, total_table_rows long").json(f"{path}/totals")
    return written.select(F.col("chunk_id").alias("key"), F.col("text").alias("value")).unionByName(
        totals.unpivot([], ["total_chunks", "total_table_rows"], "key", "n").select("key", F.col("n").cast("string").alias("value"))
    )


@query(
    "content_attached",
    """SELECT page_id, CASE WHEN length(url) % 3 = 0 THEN 'skipped' WHEN length(url) % 3 = 1 THEN 'updated' ELSE 'failed' END AS status,
      CASE WHEN length(url) % 3 = 0 THEN url WHEN length(url) % 3 = 1 THEN page_id || E'\\n' || html || E'\\n' END AS content,
      CASE WHEN length(url) % 3 = 0 THEN NULL WHEN length(url) % 3 = 1 THEN strlen(page_id || html) + 2 END::BIGINT AS file_size
    FROM pages""",
)
def content_attached(t: Inputs):
    path = write_files(t, t.pages, "page_id", "html")
    listed = read_pages(t, path).select("page_id", "path")
    # By length of the url: content already there, a file at the last candidate path, no file.
    case = F.length("url") % 3
    docs = t.pages.join(listed, "page_id").select(
        "page_id",
        F.col("page_id").cast("string").alias("source_file"),
        F.lit("u").alias("university_id"),
        F.when(case == 0, F.col("url").cast("binary")).alias("file_content"),
        F.when(case == 1, files.plain_path(F.col("path"))).alias("file_path"),
    )
    # The documents are asked for their paths and joined with the content.
    attached = files.attach_files(store.stored(docs, scratch_path(t.spark, "documents")), path, "*.txt")
    return attached.select("page_id", "status", F.col("file_content").cast("string").alias("content"), "file_size")


@query(
    "store_round_trip",
    f"""SELECT 'chunks' AS name, chunk_id AS key, text FROM ({CHUNKS}) UNION ALL
    SELECT 'documents', doc_id || '.md', lang FROM documents UNION ALL
    SELECT 'query_history', event_id::VARCHAR, event_type FROM events""",
)
def store_round_trip(t: Inputs):
    path = scratch_path(t.spark, "store")
    docs = t.documents.select(
        F.col("doc_id").alias("id"), F.concat("doc_id", F.lit(".md")).alias("source_file"), F.col("lang").alias("program")
    )
    log = t.events.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("question_type"))
    store.save_tables({"documents": docs, "chunks": chunking.build_chunks(corpus(t)), "query_history": log}, path)
    loaded = store.load_tables(t.spark, path, ["documents", "chunks", "query_history"])
    return (
        loaded["chunks"].select(F.lit("chunks").alias("name"), F.col("chunk_id").alias("key"), "text")
        .unionByName(loaded["documents"].select(F.lit("documents").alias("name"), F.col("source_file").alias("key"), F.col("program").alias("text")))
        .unionByName(loaded["query_history"].select(F.lit("query_history").alias("name"), F.col("id").cast("string").alias("key"), F.col("question_type").alias("text")))
    )
