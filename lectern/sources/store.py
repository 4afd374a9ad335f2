"""Envelopes, JSON lines and the relational tables."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import fixed

# ---- tables ---------------------------------------------------------------------------


# A table of at most this many bytes of files is spread over the cores.
SPREAD_BYTES = 64 << 20


def read_table(spark: SparkSession, path: str, spread_bytes: int = SPREAD_BYTES) -> DataFrame:
    """A Parquet table as it lies; only one of few bytes is spread over the cores.

    A small file is often a single row group and so a single task, which would leave all but one
    core idle in row-by-row text work. Larger tables are never shuffled to be read.
    """
    df = spark.read.parquet(path)
    held = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) if hasattr(df, "_jdf") else None
    if held is None or held > spread_bytes:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes a table and reads it back: derived once, then scanned with column pruning."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def file_state(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """(path, length, modification time) of every file of a table: another value means another content."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    files = []
    while found.hasNext():
        one = found.next()
        files.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return tuple(sorted(files))


# ---- text files ---------------------------------------------------------------------

# Folder of rows without a value of the partition column, as Spark names it.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path on the file system of the machines, shared by them; None for any other file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = fs.makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _file_writer(root: str, folder: str, run: str):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        own = f"{root}/_writing-{uuid.uuid4().hex}"
        places: set[str] = set()
        for batch in batches:
            for at, text in zip(batch.column("folder").to_pylist(), batch.column("value").to_pylist(), strict=True):
                place = f"{folder}={NO_VALUE if at is None else at}"
                if place not in places:
                    os.makedirs(f"{own}/{place}")
                    places.add(place)
                with open(f"{own}/{place}/part-{part:05d}-{n:07d}-{run}.txt", "wb") as file:
                    file.write(f"{text or ''}\n".encode())
                n += 1
        for place in sorted(places):
            os.makedirs(f"{root}/{place}", exist_ok=True)
            try:
                os.rename(f"{own}/{place}", f"{root}/{place}/part={part}-{run}")
            except OSError:  # another attempt of this task published the same rows of this folder
                if not os.path.isdir(f"{root}/{place}/part={part}-{run}"):
                    raise
        shutil.rmtree(own, ignore_errors=True)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return write


def write_texts(rows: DataFrame, path: str, folder: str, value: str = "value") -> None:
    """Adds one text file per row below ``path``, in a folder per value of the column ``folder`` (of plain characters).

    Spark's writer takes one process per file and checksum to set its mode on a local file system, tens of milliseconds of a
    core. There the tasks write the files themselves, into a hidden folder that is published by renaming its parts;
    an attempt that fails leaves nothing that readers see. Other file systems get Spark's writer.
    """
    root = local_path(rows.sparkSession, path)
    if root is None:
        rows.select(F.col(folder), F.col(value).alias("value")).write.mode("append").option("maxRecordsPerFile", 1).partitionBy(folder).text(path)
        return
    os.makedirs(root, exist_ok=True)
    named = rows.select(F.col(folder).cast("string").alias("folder"), F.col(value).alias("value"))
    named.mapInArrow(_file_writer(root, folder, uuid.uuid4().hex), "n long").write.format("noop").mode("overwrite").save()


# ---- JSON lines ---------------------------------------------------------------------


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One row per line; blank lines are skipped. Give a schema to save the inference pass."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


# ---- ETL envelopes --------------------------------------------------------------------

_META = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("university_id", "program", "year")]
    + [T.StructField("aliases", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in ("source_file", "chunk_type")]
)


def _item(*strings: str, **extra: T.DataType) -> T.StructType:
    fields = [T.StructField(n, T.StringType()) for n in strings]
    fields += [T.StructField(n, t) for n, t in extra.items()]
    return T.StructType([*fields, T.StructField("metadata", _META)])


_CHUNK = _item("chunk_id", "text", "summary", "section_title")
_TABLE = _item(
    "row_id", "id", "table_html", "text_fallback", "context_paragraph", "summary", "section_title", "text",
    row_index=T.LongType(),
)
ENVELOPE = T.StructType(
    [
        T.StructField("chunks", T.ArrayType(_CHUNK)),
        T.StructField("table_rows", T.ArrayType(_TABLE)),
        T.StructField("table_chunks", T.ArrayType(_TABLE)),
        T.StructField("total_chunks", T.LongType()),
        T.StructField("total_table_rows", T.LongType()),
    ]
)


def read_envelope(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, table items) of envelope files. Table items carry ``table_format``.

    A file's format is that of its first table item: ``advanced`` for unified table chunks,
    ``standard`` for rows with a context paragraph, else ``advanced``.
    """
    data = spark.read.schema(ENVELOPE).json(path, multiLine=True)
    chunks = data.select(F.explode("chunks").alias("c")).select("c.*")
    first = F.get("table_rows", F.lit(0))
    has_rows = F.size(F.coalesce("table_rows", F.array())) > 0
    kind = (
        F.when(has_rows & (first["metadata"]["chunk_type"] == "table_chunk"), "advanced")
        .when(has_rows & first["context_paragraph"].isNotNull(), "standard")
        .when(has_rows | F.col("table_chunks").isNotNull(), "advanced")
        .otherwise("none")
    )
    items = F.when(has_rows, F.col("table_rows")).otherwise(F.col("table_chunks"))
    tables = data.select(kind.alias("table_format"), F.explode(items).alias("t")).select("table_format", "t.*")
    return chunks, tables


def write_etl(chunks: DataFrame, tables: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Chunks and table items as Parquet below ``path``, with a table of totals.

    Each task writes its own file: the rows of a document lie together in one of them, and
    no folder per source multiplies the number of files.
    """
    for name, df in (("chunks", chunks), ("tables", tables)):
        df.write.mode(mode).parquet(f"{path}/{name}")
    spark = chunks.sparkSession
    etl_totals(*read_etl(spark, path)).coalesce(1).write.mode(mode).json(f"{path}/totals")


def read_etl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/tables")


def etl_totals(chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """One row: total_chunks, total_table_rows."""
    counted = chunks.select(F.lit("chunk").alias("kind")).unionByName(tables.select(F.lit("table").alias("kind")))
    is_chunk = F.col("kind") == "chunk"
    return counted.agg(F.count_if(is_chunk).alias("total_chunks"), F.count_if(~is_chunk).alias("total_table_rows"))


# ---- relational tables -------------------------------------------------------------------


TABLES = fixed.RELATIONAL_TABLES


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of a relational table in order; absent ones are null."""
    return df.select(
        *[
            (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in TABLES[table].items()
        ]
    )


def save_tables(
    tables: Mapping[str, DataFrame], path: str, mode: str = "errorifexists", format: str = "parquet", **options: str
) -> None:
    """Writes each table below ``path``. With ``format="jdbc"`` the options name the database."""
    for name, df in tables.items():
        shaped = conform(df, name) if name in TABLES else df
        if format == "jdbc":
            shaped.write.format("jdbc").options(**options, dbtable=name).mode(mode).save()
        else:
            shaped.write.format(format).options(**options).mode(mode).save(f"{path}/{name}")


def load_tables(
    spark: SparkSession, path: str, names: Iterable[str], format: str = "parquet", **options: str
) -> dict[str, DataFrame]:
    if format == "jdbc":
        return {n: spark.read.format("jdbc").options(**options, dbtable=n).load() for n in names}
    return {n: spark.read.format(format).options(**options).load(f"{path}/{n}") for n in names}
