import os

import numpy as np
import pytest
from lectern.sources import arrivals, corpus
from lectern.streaming import jobs

EMPTY = ["hidden/.x.md", "_tmp/y.md", "a/_z.md", "a/empty.md", "a/.sub/w.md", "a/c._COPYING_", "a/other.txt"]
PLAIN = ["a/one.md", "a/UPPER.MD.md", "b=1/my file é+%.md", "b=1/_k=v/_n=1.md", "deep/er/still/x.md", "line\nbreak.md"]


def tree(root):
    for n, name in enumerate([*EMPTY, *PLAIN]):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("" if name == "a/empty.md" else f"# T{n}\ntext {n}\n")
    (root / "a/raw.md").write_bytes(b"caf\xe9 \xff\x00 end")
    return str(root)


def taken(spark, src, checkpoint, out, glob="*.md"):
    found = corpus.read_arrivals(spark, src, str(checkpoint), glob).selectExpr("path", "source_file", "hex(text) AS text")
    query = found.writeStream.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).format("parquet").start(str(out))
    query.awaitTermination()
    return sorted(map(tuple, spark.read.parquet(str(out)).collect()))


@pytest.mark.parametrize("glob", ["*.md", "{o,my}*.md", "[a-z]*.md"])
def test_arrivals_are_what_the_batch_reader_finds(spark, tmp_path, glob):
    src = tree(tmp_path / "src")
    batch = corpus.read_markdown(spark, src, glob).selectExpr("path", "source_file", "hex(text) AS text")
    found = taken(spark, src, tmp_path / "cp", tmp_path / "out", glob)
    assert found == sorted(map(tuple, batch.collect())) and found
    assert arrivals.published(str(tmp_path / "cp/lists")) == 1


def test_the_driver_keeps_no_file_after_file_and_each_is_taken_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrivals, "BLOCK", 100)
    src, cp, out = tmp_path / "src", tmp_path / "cp", tmp_path / "out"
    src.mkdir()
    for n in range(300):
        (src / f"{n}.md").write_text(f"text {n}")
    run = lambda: jobs.ingest_stream(spark, str(src), str(out), str(cp)).awaitTermination()
    run()
    assert not (cp / "sources").exists()  # Spark's file source writes and holds every path there
    for n in range(300, 350):
        (src / f"{n}.md").write_text(f"text {n}")
    (src / "7.md").write_text("changed")  # a name is taken once
    run()
    run()
    rows = spark.read.parquet(str(out)).collect()
    assert sorted(r.source_file for r in rows) == sorted(f"{n}.md" for n in range(350))
    assert "changed" not in {r.text for r in rows}
    lists = str(cp / "lists")
    assert arrivals.published(lists) == 2 and sorted(os.listdir(lists)) == ["000000001", "000000002"]
    assert len(np.load(f"{lists}/000000002/seen.npy")) == 350 and not os.path.exists(f"{lists}/000000001/seen.npy")


def test_stretches_hold_every_name_once(tmp_path, monkeypatch):
    monkeypatch.setattr(arrivals, "TASK_FILES", 128)
    src, lists = tmp_path / "src", tmp_path / "lists"
    src.mkdir(), lists.mkdir()
    for n in range(1000):
        (src / f"{n}.md").touch()
    assert arrivals.extend(str(src), r".*\.md", str(lists)) == 1 == arrivals.extend(str(src), r".*\.md", str(lists))
    for tasks in (1, 5, 8, 100):
        parts = arrivals.stretches(str(lists), 1, tasks)
        assert min(tasks, 16) <= len(parts) <= 16
        raw = (lists / "000000001/names").read_bytes()
        names = [n for p in parts for n in raw[p.begin : p.end].split(b"\0")[:-1]]
        assert sorted(names) == sorted(b"%d.md" % n for n in range(1000))
        assert max(raw[p.begin : p.end].count(b"\0") for p in parts) <= (1000 if tasks < 8 and len(parts) < 8 else 128)


def test_a_walk_that_fails_leaves_no_list(tmp_path, monkeypatch):
    src, lists = tmp_path / "src", tmp_path / "lists"
    src.mkdir(), lists.mkdir()
    (src / "a.md").touch()

    def broken(root, pattern):
        yield b"a.md"
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(arrivals, "walk", broken)
        with pytest.raises(OSError, match="gone"):
            arrivals.extend(str(src), r".*\.md", str(lists))
    assert os.listdir(lists) == []
    assert arrivals.extend(str(src), r".*\.md", str(lists)) == 1


def test_spark_reads_what_it_alone_can(spark, tmp_path):
    src = tree(tmp_path / "src")
    (tmp_path / "old/sources/0").mkdir(parents=True)
    for path, glob, cp in ((f"{src}/a*", "*.md", "cp"), (src, "*", "cp"), (src, "*.gz", "cp"), (f"{src}/a/one.md", "*.md", "cp"), (src, "*.md", "old")):
        assert arrivals.stream(spark, path, glob, str(tmp_path / cp)) is None
    assert not (tmp_path / "cp").exists()
    assert arrivals.stream(spark, src, "*.md", str(tmp_path / "cp")) is not None
