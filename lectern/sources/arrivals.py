"""New files of a tree as a stream whose driver holds sixteen bytes a file.

Spark's own file source keeps every path it has seen, the state of every file and the plan of every batch on the driver,
some kilobytes a file. Here the driver walks the tree, tells new files from known ones by digests of their
names, and writes the names of the new ones to a list below the checkpoint; tasks read stretches of lists and open the files. An
offset is the number of lists. A list is published by one rename together with the digests of all names up to it, so a walk that fails leaves nothing,
and a batch that is repeated reads the same files.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lectern.sources.store import local_path

# Names that are compared with the known ones at once, names between two marked places of a list, and names of a task at most.
BLOCK, STRETCH, TASK_FILES = 1 << 16, 64, 1 << 14
# Bytes and rows of a batch that a task hands to Spark, at most (one file at least).
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1_000
# Extensions that Spark's reader unpacks.
PACKED = {"bz2", "deflate", "gz", "lz4", "passthrough", "snappy", "zst"}


def _hidden(name: bytes) -> bool:
    return name.startswith(b".") or name.endswith(b"._COPYING_") or (name.startswith(b"_") and b"=" not in name)


def walk(root: bytes, pattern: str) -> Iterator[bytes]:
    """Paths below ``root``, relative to it, of all files that Spark's reader would list; a folder that goes meanwhile is empty."""
    wanted, folders = re.compile(pattern, re.DOTALL).fullmatch, [b""]
    while folders:
        folder = folders.pop()
        try:
            entries = os.scandir(os.path.join(root, folder))
        except FileNotFoundError:
            if not folder:
                raise
            continue
        with entries:
            for entry in entries:
                if _hidden(entry.name):
                    continue
                if entry.is_dir():
                    folders.append(os.path.join(folder, entry.name))
                elif wanted(os.fsdecode(entry.name)):
                    yield os.path.join(folder, entry.name)


def digests(names: list[bytes]) -> np.ndarray:
    from hashlib import blake2b

    return np.array([blake2b(n, digest_size=16).digest() for n in names], "S16")


def _known(seen: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(seen):
        return np.zeros(len(found), bool)
    at = np.searchsorted(seen, found)
    return seen[np.minimum(at, len(seen) - 1)] == found


def _list(lists: str, number: int) -> str:
    return f"{lists}/{number:09d}"


def published(lists: str) -> int:
    """The number of lists; they are numbered from one."""
    return max((int(n) for n in os.listdir(lists) if n.isdigit()), default=0)


def extend(root: str, pattern: str, lists: str) -> int:
    """Writes the files that no list names to a new list, if there are any; the number of lists."""
    last = published(lists)
    seen = np.load(f"{_list(lists, last)}/seen.npy", mmap_mode="r") if last else np.zeros(0, "S16")
    own = f"{lists}/.{uuid.uuid4().hex}"
    os.mkdir(own)
    new, marks, count, block = [], [], 0, []
    try:
        with open(f"{own}/names", "wb") as out:

            def add(names: list[bytes]) -> None:
                nonlocal count
                found = digests(names)
                fresh = np.flatnonzero(~_known(seen, found))
                new.append(found[fresh])
                for i in fresh.tolist():
                    if count % STRETCH == 0:
                        marks.append(out.tell())
                    out.write(names[i] + b"\0")
                    count += 1

            for name in walk(os.fsencode(root), pattern):
                block.append(name)
                if len(block) == BLOCK:
                    add(block)
                    block = []
            add(block)
            marks.append(out.tell())
        if not count:
            return last
        np.save(f"{own}/marks.npy", np.array(marks, np.int64))
        both = np.concatenate([seen, *new])
        both.sort()
        np.save(f"{own}/seen.npy", both)
        os.rename(own, _list(lists, last + 1))
    finally:
        shutil.rmtree(own, ignore_errors=True)
    if last:  # the new list holds the digests of all
        os.remove(f"{_list(lists, last)}/seen.npy")
    return last + 1


@dataclass
class Stretch(InputPartition):
    """Bytes of a list's names."""

    names: str
    begin: int
    end: int


def stretches(lists: str, number: int, tasks: int) -> list[Stretch]:
    """A list cut for about ``tasks`` tasks, of some names and at most ``TASK_FILES`` each."""
    marks = np.load(f"{_list(lists, number)}/marks.npy")
    spans = len(marks) - 1
    parts = min(spans, max(tasks, -(-spans * STRETCH // TASK_FILES)))
    edges = marks[np.arange(parts + 1) * spans // parts].tolist()
    return [Stretch(f"{_list(lists, number)}/names", a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _batch(paths: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
    # Bytes are handed on as they are, like Spark's reader does.
    columns = [pa.Array.from_buffers(pa.string(), len(c), pa.array(c, pa.binary()).buffers()) for c in (paths, texts)]
    return pa.RecordBatch.from_arrays(columns, names=["path", "text"])


class ArrivalsReader(DataSourceStreamReader):
    def __init__(self, root: str, pattern: str, lists: str, tasks: int):
        self.root, self.pattern, self.lists, self.tasks = root, pattern, lists, tasks

    def initialOffset(self) -> dict:
        return {"lists": 0}

    def latestOffset(self) -> dict:
        return {"lists": extend(self.root, self.pattern, self.lists)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return [s for n in range(start["lists"] + 1, end["lists"] + 1) for s in stretches(self.lists, n, self.tasks)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        with open(partition.names, "rb") as file:
            file.seek(partition.begin)
            names = file.read(partition.end - partition.begin).split(b"\0")[:-1]
        root = os.fsencode(self.root.rstrip("/"))
        paths, texts, held = [], [], 0
        for name in names:
            with open(root + b"/" + name, "rb") as file:
                text = file.read()
            if not text:  # Spark's reader has no row for an empty file
                continue
            if paths and (held + len(text) > BATCH_BYTES or len(paths) == BATCH_ROWS):
                yield _batch(paths, texts)
                paths, texts, held = [], [], 0
            paths.append(b"file:" + root + b"/" + name)
            texts.append(text)
            held += len(text)
        if paths:
            yield _batch(paths, texts)


class Arrivals(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lectern_arrivals"

    def schema(self) -> str:
        return "path string, text string"

    def streamReader(self, schema) -> ArrivalsReader:
        o = self.options
        return ArrivalsReader(o["root"], o["pattern"], o["lists"], int(o["tasks"]))


def stream(spark: SparkSession, path: str, glob: str, checkpoint: str) -> DataFrame | None:
    """``path, text`` of new files below a folder on the machines' shared file system; None where Spark's source has to do it.

    That is another file system, a pattern or a single file as ``path``, a glob that may match packed files, and a
    checkpoint that Spark's source began.
    """
    ending = re.search(r"\.(\w+)$", glob)
    root, place = local_path(spark, path), local_path(spark, checkpoint)
    if not ending or ending[1].lower() in PACKED or re.search(r"[*?\[\]{}\\]", path) or root is None or place is None or not os.path.isdir(root):
        return None
    lists = f"{place}/lists"
    if os.path.isdir(f"{place}/sources") and not os.path.isdir(lists):
        return None
    os.makedirs(lists, exist_ok=True)
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    spark.dataSource.register(Arrivals)
    options = {"root": root, "pattern": pattern, "lists": lists, "tasks": str(4 * spark.sparkContext.defaultParallelism)}
    return spark.readStream.format(Arrivals.name()).options(**options).load()
