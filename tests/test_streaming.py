import datetime as dt

from pyspark.sql import functions as F

from lectern.operators import embedding, retrieval
from lectern.plans import QUERIES
from lectern.sources import corpus
from lectern.streaming import jobs


def test_files_are_ingested_once(spark, tmp_path):
    src, out, checkpoint = (tmp_path / n for n in ("in", "out", "cp"))
    src.mkdir()
    (src / "a.md").write_text("## A\n\none\n", encoding="utf-8")

    def run():
        jobs.ingest_stream(spark, str(src), str(out), str(checkpoint)).awaitTermination()
        rows = spark.read.parquet(str(out)).collect()
        return sorted((r["source_file"], r["section_title"], r["chunk_id"]) for r in rows)

    assert run() == [("a.md", "A", "UNKNOWN_General_2024_chunk_1")]
    (src / "b.md").write_text("plain", encoding="utf-8")
    assert [r[0] for r in run()] == ["a.md", "b.md"]
    assert [r[0] for r in run()] == ["a.md", "b.md"]


def test_ingest_stream_names_files_as_the_batch_reader(spark, tmp_path):
    folder = tmp_path / "src" / "Universities" / "X Y+é"
    folder.mkdir(parents=True)
    (folder / "my file é+%.md").write_text("# T\ntext", encoding="utf-8")
    jobs.ingest_stream(spark, str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out")).first()
    batch = corpus.derive_path_metadata(corpus.read_markdown(spark, str(tmp_path / "src"))).first()
    assert (row["source_file"], row["university_id"]) == (batch["source_file"], batch["university_id"]) == ("my file é+%.md", "X Y+é")


def test_late_rows_update_open_windows_only(spark, tmp_path):
    src, out = tmp_path / "log", tmp_path / "out"
    schema = "ts timestamp_ntz, event_type string, value double"
    day = lambda d, h=12: dt.datetime(2024, 1, d, h)

    def deliver(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        jobs.query_stats_stream(stream, str(out), str(tmp_path / "cp"), delay="1 hour").awaitTermination()

    deliver((day(1), "qa", 1.0), (day(1), "qa", 3.0))
    deliver((day(1, 23), "qa", 5.0), (day(3), "qa", 7.0))  # the first day is still open
    deliver((day(1), "qa", 100.0), (day(3), "qa", 9.0))  # now it is closed
    rows = jobs.latest_windows(spark, str(out)).orderBy("window_start").collect()
    assert [(r["window_start"].day, r["queries"], r["mean"]) for r in rows] == [(1, 3, 3.0), (3, 2, 8.0)]


def test_answer_stream_equals_batch(spark, tmp_path):
    rows = [("i1", "alpha beta"), ("i2", "beta gamma"), ("i3", "delta")]
    items = embedding.embed(spark.createDataFrame(rows, "item_id string, text string"))
    questions = spark.createDataFrame([(1, "beta"), (2, "delta  alpha")], "query_id int, question string")
    questions.write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema(questions.schema).parquet(str(tmp_path / "q"))
    jobs.answer_stream(stream, {"chunk": items}, str(tmp_path / "out"), str(tmp_path / "cp"), k=2).awaitTermination()
    asked = embedding.embed(questions.select("query_id", F.col("question").alias("text")))
    batch = retrieval.search_and_rerank({"chunk": items}, asked, 2)
    columns = ["query_id", "item_id", "rank"]
    found = spark.read.parquet(str(tmp_path / "out")).select(*columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.select(*columns).collect()))


def test_a_table_is_streamed_as_one_file_or_as_a_folder(spark, tmp_path):
    rows = [(1, t, "user", f"What is the deadline of course {t}?") for t in range(6)] + [(2, 0, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.repartition(3, "turn").write.parquet(str(tmp_path / "folder" / "conversations.parquet"))
    turns.coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "file" / "conversations.parquet")
    expected = sorted(map(str, QUERIES["question_records"](spark, str(tmp_path / "folder")).collect()))
    for kind in ("folder", "file"):
        found = QUERIES["stream_question_records"](spark, str(tmp_path / kind))
        assert sorted(map(str, found.collect())) == expected, kind
    assert len(expected) == 7
