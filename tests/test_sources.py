import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lectern import session
from lectern.sources import corpus, store


def tree(tmp_path):
    folder = tmp_path / "Universities" / "Uni x+y"
    folder.mkdir(parents=True)
    (folder / "a.md").write_text("## A\n\nfirst\nsecond\n", encoding="utf-8")
    (tmp_path / "b c.md").write_text("é", encoding="utf-8")
    (tmp_path / "skip.txt").write_text("no", encoding="utf-8")
    return tmp_path


def test_markdown_tree(spark, tmp_path):
    files = corpus.read_markdown(spark, str(tree(tmp_path)))
    rows = {r["source_file"]: r for r in corpus.derive_path_metadata(files).collect()}
    assert set(rows) == {"a.md", "b c.md"}
    assert rows["a.md"]["text"] == "## A\n\nfirst\nsecond\n"
    assert (rows["a.md"]["university_id"], rows["a.md"]["program"], rows["a.md"]["year"]) == ("Uni x+y", "General", "2024")
    assert rows["b c.md"]["university_id"] == "UNKNOWN"


def test_given_metadata_wins(spark):
    df = spark.createDataFrame([("/x/Universities/U/f.md", "Mine", "")], "path string, university_id string, program string")
    row = corpus.derive_path_metadata(df).first()
    assert (row["university_id"], row["program"]) == ("Mine", "General")


def test_manifest(spark, tmp_path):
    root = tree(tmp_path)
    manifest = {
        "files": [
            {"file": "Universities/Uni x+y/a.md", "university_id": "UNI", "aliases": ["x"], "year": "2022"},
            {"file": "./b c.md", "university_id": "B"},
            {"file": "gone.md", "university_id": "G"},
        ]
    }
    (root / "manifest.json").write_text(json.dumps(manifest, indent=1), encoding="utf-8")
    entries = corpus.read_manifest(spark, str(root / "manifest.json"))
    applied = corpus.apply_manifest(corpus.read_markdown(spark, str(root)), entries, str(root))
    rows = {r["university_id"]: r for r in applied.collect()}
    assert rows["UNI"]["found"] and rows["UNI"]["text"].startswith("## A") and rows["UNI"]["aliases"] == ["x"]
    assert rows["B"]["text"] == "é"
    assert not rows["G"]["found"] and rows["G"]["text"] is None


def test_content_by_candidate_order(spark, tmp_path):
    root = tree(tmp_path)
    best = root / "data" / "processed" / "MD"
    best.mkdir(parents=True)
    (best / "a.md").write_text("best", encoding="utf-8")
    docs = spark.createDataFrame(
        [
            ("a.md", "U", str(root / "b c.md"), None),
            ("b c.md", "U", str(root / "b c.md"), None),
            ("no.md", "U", None, None),
            ("had.md", "U", None, bytearray(b"kept")),
        ],
        "source_file string, university_id string, file_path string, file_content binary",
    )
    attached = corpus.attach_content(docs, corpus.read_files(spark, str(root), "*.md"), corpus.candidate_paths(str(root)))
    rows = {r["source_file"]: r for r in attached.collect()}
    assert bytes(rows["a.md"]["file_content"]) == b"best" and rows["a.md"]["file_size"] == 4
    assert (rows["b c.md"]["status"], rows["no.md"]["status"], rows["had.md"]["status"]) == ("updated", "failed", "skipped")
    assert bytes(rows["had.md"]["file_content"]) == b"kept"


@pytest.mark.parametrize("opened", [100, 1])
def test_only_chosen_files_are_opened(spark, tmp_path, opened):
    names = ["a.md", "b c.md", "g[1]*.md", "q?{x}.md", "p+%41.md", "back\\slash.md"]
    for i, name in enumerate([*names, *[f"other{i}.md" for i in range(20)]]):
        (tmp_path / name).write_text(f"text {i}")
    docs = spark.createDataFrame(
        [(n, None, str(tmp_path / n), None) for n in names[:5]] + [("no.md", None, None, None), ("had.md", None, str(tmp_path / "other1.md"), bytearray(b"kept"))],
        "source_file string, university_id string, file_path string, file_content binary",
    )
    attached = corpus.attach_files(docs, str(tmp_path), "*.md", opened=opened)
    rows = {r["source_file"]: r for r in attached.collect()}
    assert len(rows) == 7 and rows["no.md"]["status"] == "failed" and bytes(rows["had.md"]["file_content"]) == b"kept"
    for i, name in enumerate(names[:5]):
        assert bytes(rows[name]["file_content"]).decode() == f"text {i}" and rows[name]["status"] == "updated", name
    scanned = {f.rsplit("/", 1)[1] for f in attached.inputFiles()}
    assert len(scanned) == (5 if opened == 100 else 26)


def test_no_chosen_file(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    docs = spark.createDataFrame([("no.md", "U", "nowhere")], "source_file string, university_id string, file_path string")
    assert [r["status"] for r in corpus.attach_files(docs, str(tmp_path)).collect()] == ["failed"]
    assert corpus.attach_files(docs.limit(0), str(tmp_path)).count() == 0


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "é"}\n\n  \n{"a": 2}\n', encoding="utf-8")
    assert sorted((r["a"], r["b"]) for r in store.read_jsonl(spark, str(tmp_path / "x.jsonl")).collect()) == [(1, "é"), (2, None)]
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    store.write_jsonl(df, str(tmp_path / "out"))
    assert sorted(map(tuple, store.read_jsonl(spark, str(tmp_path / "out"), df.schema).collect())) == [(1, None), (2, "x")]


def envelope(tmp_path, name, **parts):
    (tmp_path / name).write_text(json.dumps(parts, indent=2), encoding="utf-8")


def test_envelope_formats(spark, tmp_path):
    chunk = {"chunk_id": "c", "text": "t", "metadata": {"source_file": "f"}}
    envelope(tmp_path, "1.json", chunks=[chunk], table_rows=[{"row_id": "s", "context_paragraph": "", "text_fallback": "k: v"}])
    envelope(tmp_path, "2.json", chunks=[], table_rows=[{"id": "a", "text": "x", "metadata": {"chunk_type": "table_chunk"}}])
    envelope(tmp_path, "3.json", chunks=[chunk], table_chunks=[{"id": "e", "text": "x"}])
    envelope(tmp_path, "4.json", chunks=[chunk], table_rows=[])
    chunks, tables = store.read_envelope(spark, str(tmp_path))
    assert chunks.count() == 3
    found = {(r["row_id"] or r["id"]): r["table_format"] for r in tables.collect()}
    assert found == {"s": "standard", "a": "advanced", "e": "advanced"}


def test_store(spark, tmp_path):
    log = spark.createDataFrame([(1, "q")], "id int, question string")
    store.save_tables({"query_history": log, "extra": log}, str(tmp_path / "s"))
    loaded = store.load_tables(spark, str(tmp_path / "s"), ["query_history", "extra"])
    assert loaded["query_history"].columns == list(store.TABLES["query_history"])
    assert loaded["query_history"].first()["question"] == "q" and loaded["extra"].columns == ["id", "question"]


def test_small_tables_are_spread_and_large_ones_left(spark, sf, tmp_path):
    df = store.read_table(spark, f"{sf}/documents.parquet")
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    large = store.read_table(spark, f"{sf}/documents.parquet", spread_bytes=1000)
    assert "Repartition" not in large._jdf.queryExecution().optimizedPlan().toString()


class FakeSession:
    def __init__(self, master, folder):
        self.sparkContext = SimpleNamespace(master=master, applicationId="app")
        self.conf = SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default)


def test_shared_folder_comes_from_the_session():
    assert session.scratch_path(FakeSession("yarn", "hdfs://x/cp/"), "t").startswith("hdfs://x/cp/t-")
    assert session.scratch_path(FakeSession("local[2]", None), "t") != session.scratch_path(FakeSession("local[2]", None), "t")
    with pytest.raises(RuntimeError):  # a machine-local folder is no shared folder
        session.shared_dir(FakeSession("yarn", None))


def test_path_text(spark):
    df = spark.createDataFrame([("file:///a/b.md",), ("/a/b.md",), ("s3://x/b.md",)], "p string")
    assert [r["q"] for r in df.select(corpus.plain_path(F.col("p")).alias("q")).collect()] == ["/a/b.md", "/a/b.md", "s3://x/b.md"]
