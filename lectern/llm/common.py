"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import scratch_path

# Sides of at most this many bytes, by a count of their rows, are sent to every task.
BROADCAST_BYTES = 32 << 20


# Name of the row number that ``numbered`` adds, and the room for rows of one file in it.
ROW, FILE_ROWS = "_row_number_of_table", 1 << 40
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lets Spark hand texts to Python in batches of at most ``most`` bytes (and one row).

    Buffers of a batch stay with the executor and with the Python worker for their whole life, so the
    default of 64 MB costs several times that for each core. A smaller setting is left alone.
    """
    given = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(ARROW_BYTES))
    if given <= 0 or given > most:
        spark.conf.set(ARROW_BYTES, str(most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written once below the shared folder and read back: a cut in the lineage."""
    bound_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast when its counted rows stay below ``BROADCAST_BYTES``.

    Beyond that it is returned unmarked, and the join it goes into shuffles both sides.
    ``df`` should be a written table, since it is counted here and read again by the join.
    """
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def whole_ids(docs: DataFrame, id_col: str) -> Column:
    """The id column of an operator that orders documents by number; other types are refused before anything runs."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise TypeError(f"{id_col} must be a whole number to order documents by, not {kind.simpleString()}")
    return F.col(id_col)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _placed(docs: DataFrame) -> DataFrame | None:
    """``docs`` with file and index of each row, if it is a plain scan of Parquet files."""
    plan = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() if hasattr(docs, "_jdf") else ""
    if plan != "LogicalRelation":
        return None
    at = docs.metadataColumn("_metadata")
    try:
        return docs.select("*", at["file_path"].alias(f"{ROW}_file"), at["row_index"].alias(f"{ROW}_index"))
    except AnalysisException:  # another file format
        return None


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a row number ``ROW`` that every later job finds the same.

    It is made of the place of the row's file among all files and the row's place in it, so it does not depend on how
    a scan is split, which follows the cores that the cluster has at that moment. Anything but a plain scan of Parquet files
    is written once and read from there. Numbers follow the order of file names and of rows.
    """
    if ROW in docs.columns:
        return docs
    placed = _placed(docs)
    if placed is None:
        placed = _placed(written(docs, "numbered"))
    names = placed.select(F.col(f"{ROW}_file").alias("file")).distinct()
    # One row per file, whatever the number of rows.
    files = written(names.select("file", (F.row_number().over(Window.orderBy("file")) - 1).alias("place")), "files")
    places = sized(files.select(F.col("file").alias(f"{ROW}_file"), F.col("place").alias(f"{ROW}_place")), 256)
    number = F.col(f"{ROW}_place").cast("long") * FILE_ROWS + F.col(f"{ROW}_index")
    return placed.join(places, f"{ROW}_file").select(*[F.col(f"`{c}`") for c in docs.columns], number.alias(ROW))


def row_number(docs: DataFrame) -> Column:
    """The number that ``numbered`` gave, else one that holds within a single job."""
    return F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()


def without_rows(docs: DataFrame, dropped: DataFrame, row: str = "row") -> DataFrame:
    """The rows of ``docs`` (a ``numbered`` table) whose number is not in ``dropped``, without the number.

    Rows are told apart by number because ids may repeat.
    """
    gone = sized(dropped.select(F.col(row).alias(ROW)), 16)
    return docs.join(gone, ROW, "left_anti").drop(ROW)
