"""Rows keep their numbers when the cluster's cores change between two jobs."""

import random

import pytest
from lectern.llm import decontaminate, exact_dedup, jaccard, langid, lines, recurrent_lm, substring
from lectern.llm.common import ROW, numbered

CORES = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture
def table(spark, tmp_path):
    """Sixteen small files, which scans of two and of six cores group differently."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(8)) for _ in range(40)]
    rows = [(i, texts[i % 40] + ("" if i < 40 else "\n"), "en") for i in range(100)] + [(200, None, None), (201, "12", "en")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(16).write.parquet(path)
    yield spark.read.parquet(path)
    spark.conf.unset(CORES)


def with_cores_changing(spark, monkeypatch, build):
    """Result of an operator for whose every written table the number of cores changes."""
    from lectern.llm import common

    plain, cores = common.scratch_path, iter(range(10**6))

    def changing(*args):
        spark.conf.set(CORES, str(2 + 4 * (next(cores) % 2)))
        return plain(*args)

    monkeypatch.setattr(common, "scratch_path", changing)
    spark.conf.set(CORES, "2")
    df = build()
    spark.conf.set(CORES, "6")
    found = sorted(map(tuple, df.collect()), key=str)
    monkeypatch.undo()
    return found


def test_splits_do_change(spark, table):
    spark.conf.set(CORES, "2")
    few = table.rdd.getNumPartitions()
    spark.conf.set(CORES, "6")
    assert table.select("doc_id").rdd.getNumPartitions() != few


def test_numbers_stay(spark, table, tmp_path):
    spark.conf.set(CORES, "2")
    first = numbered(table)
    once = {tuple(r) for r in first.collect()}
    spark.conf.set(CORES, "6")
    assert {tuple(r) for r in first.collect()} == once == {tuple(r) for r in numbered(table).collect()}
    assert len({r[-1] for r in once}) == table.count() and first.columns == [*table.columns, ROW]
    assert numbered(first) is first
    # Not a plain scan, another format, a column named like the metadata.
    for other in (table.filter("doc_id >= 0"), table.crossJoin(spark.range(1)), table.withColumnRenamed("lang", "_metadata")):
        assert numbered(other).select(ROW).distinct().count() == other.count()
    table.write.json(str(tmp_path / "json"))
    assert numbered(spark.read.json(str(tmp_path / "json"))).select(ROW).distinct().count() == 102


OPERATORS = {
    "exact": (exact_dedup.drop_exact_duplicates, 42),
    "near": (lambda d: jaccard.drop_near_duplicates(d), 42),
    "language": (langid.drop_unidentified, 100),
    "components": (lambda d: jaccard.jaccard_components(d).select("doc_id", "n_shingles", "component_id"), 102),
    "lines": (lambda d: lines.remove_repeated_lines(d).drop("row"), 102),
    "substring": (lambda d: substring.remove_repeats(d).drop("row"), 102),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_ignore_the_cores(spark, table, name, monkeypatch):
    build, n = OPERATORS[name]
    spark.conf.set(CORES, "4")
    expected = sorted(map(tuple, build(table).collect()), key=str)
    assert len(expected) == n
    assert with_cores_changing(spark, monkeypatch, lambda: build(table)) == expected


def test_decontamination_ignores_the_cores(spark, table, monkeypatch):
    items = spark.createDataFrame([(1, table.filter("doc_id = 3").first().text[:150])], "item_id long, text string")
    left = with_cores_changing(spark, monkeypatch, lambda: decontaminate.drop_contaminated(table, items).select("doc_id"))
    assert sorted(set(range(100)) - {r[0] for r in left}) == [3, 43, 83]


def test_every_document_is_scored_once(spark, table, monkeypatch):
    found = with_cores_changing(spark, monkeypatch, lambda: recurrent_lm.score(table).select("doc_id", "n_tokens", "n_known"))
    assert len(found) == len({r[0] for r in found}) == 102


@pytest.mark.parametrize("operator", [lines.remove_repeated_lines, substring.remove_repeats])
def test_ids_that_are_no_numbers_are_refused(spark, operator):
    with pytest.raises(TypeError, match="whole number"):
        operator(spark.createDataFrame([("a", "text")], "doc_id string, text string"))
