"""One file per row: written without a checksum file or a process each, read by few tasks."""

import os

from pyspark.sql import functions as F

from lectern.session import scratch_path
from lectern.sources import corpus, store


def test_texts_are_written_one_file_per_row(spark):
    rows = [("Université n° 1", "é\nb"), ("Université n° 1", "é\nb"), ("b", None), (None, "d"), ("b", "")]
    df = spark.createDataFrame(rows, "at string, value string").repartition(3)
    path = scratch_path(spark, "texts")
    store.write_texts(df, path, "at")
    store.write_texts(df.filter("at = 'b'"), path, "at")
    found = corpus.read_markdown(spark, path, "*.txt").withColumn("at", F.regexp_extract("path", "at=([^/]+)/", 1)).collect()
    want = [("Université n° 1", "é\nb\n")] * 2 + [("b", "\n")] * 4 + [(store.NO_VALUE, "d\n")]
    assert sorted((r["at"], r["text"]) for r in found) == sorted(want)
    assert len({r["source_file"] for r in found}) == len(want)
    names = [name for _, _, files in os.walk(path) for name in files]
    assert len(names) == len(want) and not [n for n in names if n.endswith(".crc")]


def test_no_rows_leave_a_folder(spark):
    path = scratch_path(spark, "texts")
    store.write_texts(spark.createDataFrame([], "at string, value string"), path, "at")
    assert corpus.read_markdown(spark, path, "*.txt").count() == 0


def test_small_files_do_not_multiply_tasks(spark, tmp_path):
    for i in range(700):
        (tmp_path / f"{i}.md").write_text(str(i))
    files = corpus.read_markdown(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(int(r.text) for r in files.collect()) == list(range(700))
