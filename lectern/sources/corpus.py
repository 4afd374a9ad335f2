"""Markdown corpora, manifests, path metadata and raw file content."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import fixed
from lectern.session import scratch_path
from lectern.sources import arrivals
from lectern.sources.store import stored

# Chosen paths that are sent to the scan of file contents, at most.
SENT_PATHS = 1 << 17
# Chosen files that are opened by name, at most; a name is at most some hundred bytes.
OPENED_PATHS = 1 << 14

MANIFEST = T.StructType(
    [
        T.StructField(
            "files",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("file", T.StringType()),
                        T.StructField("university_id", T.StringType()),
                        T.StructField("program", T.StringType()),
                        T.StructField("year", T.StringType()),
                        T.StructField("aliases", T.ArrayType(T.StringType())),
                        T.StructField("language", T.StringType()),
                        T.StructField("document_type", T.StringType()),
                    ]
                )
            ),
        )
    ]
)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _decoded(path: Column) -> Column:
    """File paths in the scan metadata are URL-encoded; a plus sign there is literal."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _few_tasks(files: DataFrame) -> DataFrame:
    """The same files in at most four tasks a core: Spark counts a file as 4 MB at least, so small ones make a task of 32 each."""
    return files.coalesce(4 * files.sparkSession.sparkContext.defaultParallelism)


def read_markdown(spark: SparkSession, path: str, glob: str = "*.md", stream: bool = False) -> DataFrame:
    """(path, source_file, text), one row per file of the tree; of new files as a stream if asked."""
    reader = spark.readStream if stream else spark.read
    files = reader.option("pathGlobFilter", glob).text(path, wholetext=True, recursiveFileLookup=True)
    full = _decoded(F.col("_metadata.file_path"))
    return _few_tasks(files.select(full.alias("path"), file_name(full).alias("source_file"), F.col("value").alias("text")))


def read_arrivals(spark: SparkSession, path: str, checkpoint: str, glob: str = "*.md") -> DataFrame:
    """The same of new files as a stream, whose position and list of files lie below ``checkpoint``."""
    found = arrivals.stream(spark, path, glob, checkpoint)
    if found is None:
        return read_markdown(spark, path, glob, stream=True)
    return found.select("path", file_name(F.col("path")).alias("source_file"), "text")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest entry."""
    entries = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("files").alias("f"))
    return entries.select("f.*")


def plain_path(path: Column) -> Column:
    """A path without the scheme of the local file system."""
    return F.regexp_replace(path, r"^file:/+", "/")


def apply_manifest(files: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """Manifest entries with their file's text; ``found`` is false for a missing file.

    Relative entries are resolved against ``root``. The join is on the whole path, which is
    unique, so common file names do not meet each other.
    """
    entry = F.regexp_replace(F.col("file"), r"^\./", "")
    resolved = F.when(F.rlike(entry, F.lit("^(/|[a-z0-9]+:/)")), entry).otherwise(
        F.concat(F.lit(root.rstrip("/") + "/"), entry)
    )
    wanted = manifest.withColumn("_at", plain_path(resolved))
    listed = files.select(plain_path(F.col("path")).alias("_at"), "path", "source_file", "text")
    return wanted.join(listed, "_at", "left").withColumn("found", F.col("path").isNotNull()).drop("_at")


def derive_path_metadata(df: DataFrame, path: str = "path", marker: str = "Universities") -> DataFrame:
    """University from the path, default program and year; given non-empty values win."""
    segment = F.regexp_extract(F.col(path), rf"(?:^|/){marker}/([^/]+)", 1)

    def given(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")) if name in df.columns else F.lit(None).cast("string")

    return df.withColumns(
        {
            "university_id": F.coalesce(
                given("university_id"), F.nullif(segment, F.lit("")), F.lit(fixed.DEFAULT_UNIVERSITY)
            ),
            "program": F.coalesce(given("program"), F.lit(fixed.DEFAULT_PROGRAM)),
            "year": F.coalesce(given("year"), F.lit(fixed.DEFAULT_YEAR)),
        }
    )


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, file_size, content) of every file."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    )
    return found.select("path", F.col("length").alias("file_size"), "content")


def candidate_paths(base: str = "") -> Column:
    """Where a document's file may lie, best place first."""
    lead = base.rstrip("/") + "/" if base else ""
    return F.array(
        F.concat(F.lit(lead + "data/processed/MD/"), F.col("source_file")),
        F.concat(F.lit(lead + "data/raw/Universities/"), F.col("university_id"), F.lit("/"), F.col("source_file")),
        F.col("file_path"),
    )


def _chosen(documents: DataFrame, listed: DataFrame, options: Column) -> DataFrame:
    """(source_file, _path): the best candidate that exists, for documents without content."""
    has = F.col("file_content").isNotNull() if "file_content" in documents.columns else F.lit(False)
    asked = documents.filter(~has).select("source_file", F.posexplode(options).alias("_place", "_path"))
    return asked.join(listed, "_path").groupBy("source_file").agg(F.min_by("_path", "_place").alias("_path"))


def _literal(path: str) -> str:
    """A path in which characters of a glob stand for themselves."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def attach_files(
    documents: DataFrame, root: str, glob: str = "*", candidates: Column | None = None, opened: int = OPENED_PATHS
) -> DataFrame:
    """:func:`attach_content` for the files of a tree, of which only the chosen ones are opened.

    The tree is listed without content. Up to ``opened`` distinct chosen files are then read by name, so files that
    no document asks for are not even scanned; more are joined with a scan of the tree, with the same result.
    """
    spark = documents.sparkSession
    options = candidates if candidates is not None else candidate_paths()
    # Listed once: each look at a tree visits all of its files.
    listing = stored(_few_tasks(read_files(spark, root, glob).select("path")), scratch_path(spark, "listing"))
    listed = listing.select(plain_path(F.col("path")).alias("_path"), "path")
    names = _chosen(documents, listed.select("_path"), options).select("_path").distinct().join(listed, "_path")
    few = [r.path for r in names.select("path").limit(opened + 1).collect()]
    if len(few) > opened:
        return attach_content(documents, read_files(spark, root, glob), options)
    if not few:
        return attach_content(documents, spark.createDataFrame([], "path string, file_size long, content binary"), options)
    files = spark.read.format("binaryFile").load([_literal(p) for p in few])
    return attach_content(documents, files.select("path", F.col("length").alias("file_size"), "content"), options)


def attach_content(documents: DataFrame, files: DataFrame, candidates: Column | None = None) -> DataFrame:
    """Documents with ``file_content``, ``file_size`` and ``status`` (updated, skipped, failed).

    Candidate paths are matched to the list of files, without their content, before any content is
    read. Few chosen paths are sent to the scan of the contents, so that content which nobody asks
    for is dropped where it is read; many are joined by path.
    """
    options = candidates if candidates is not None else candidate_paths()
    chosen = _chosen(documents, _few_tasks(files.select(plain_path(F.col("path")).alias("_path"))), options)
    content = files.select(
        plain_path(F.col("path")).alias("_path"), F.col("content").alias("_content"), F.col("file_size").alias("_size")
    )
    few = chosen.limit(SENT_PATHS + 1).count() <= SENT_PATHS
    loaded = content.join(F.broadcast(chosen) if few else chosen, "_path").drop("_path")
    base = documents
    for name, kind in (("file_content", "binary"), ("file_size", "long")):
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast(kind))
    joined = base.join(loaded, "source_file", "left")
    return joined.withColumns(
        {
            "status": F.when(F.col("file_content").isNotNull(), "skipped")
            .when(F.col("_content").isNotNull(), "updated")
            .otherwise("failed"),
            "file_content": F.coalesce("file_content", "_content"),
            "file_size": F.coalesce("file_size", "_size"),
        }
    ).drop("_content", "_size")
