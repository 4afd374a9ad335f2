import random

import corpus_pipeline
import pytest
from lectern.llm import queries

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row long, component string"


@pytest.fixture
def corpus(spark, tmp_path):
    """Rows with a known fate: (id, text, language, what happens to it)."""
    rng = random.Random(5)
    words = {"en": [f"the{i}and" for i in range(150)], "fr": [f"é{i}eaux" for i in range(150)]}

    def prose(lang, n=120):
        return " ".join(rng.choice(words[lang]) for _ in range(n))

    items = [prose("en", n) for n in (8, 15, 40)]
    rows = [(i, prose("en" if i % 2 else "fr"), "en" if i % 2 else "fr", "kept") for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(" ", "", 1), rows[i][2], "copy") for i in range(5)]
    rows += [(0, rows[0][1], "fr", "copy"), (200, None, "en", "no language"), (201, "", None, "no language"), (202, "12 34 !?", "fr", "no language")]
    for i in range(20, 26):
        ws = rows[i][1].split()
        ws[60] = "changed"
        rows.append((300 + i, " ".join(ws), rows[i][2], "near"))
    rows += [(400 + k, prose("en", 40) + " " + item.upper() + ", " + prose("en", 40), "en", "contaminated") for k, item in enumerate(items)]
    rows += [(500, "short text", "en", "kept"), (None, prose("fr"), "fr", "kept"), (501, prose("en", 6000), "en", "kept")]
    path = tmp_path / "sf"
    docs = spark.createDataFrame([(d, t, lang, "s", len(t or ""), 1, "c") for d, t, lang, _ in rows], DOCUMENTS)
    docs.repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows


def test_every_stage_takes_effect(spark, corpus, tmp_path):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    gone = {"no language": "language", "copy": "exact_dedup", "near": "near_dedup", "contaminated": "decontaminate"}
    left = list(rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        left = [r for r in left if gone.get(r[3]) != name]
        # Which of two near copies stays depends on their order in the table.
        shown = [r.doc_id - 300 if r.doc_id and 300 <= r.doc_id < 400 and name in ("near_dedup", "decontaminate") else r.doc_id for r in docs.collect()]
        assert sorted(map(str, shown)) == sorted(str(d) for d, *_ in left), name


def test_run_packs_what_is_left(spark, corpus):
    path, _ = corpus
    found = corpus_pipeline.run(spark, path).collect()
    ids = {r.doc_id for r in found}
    assert {500, 501, None} <= ids and not ids & {200, 201, 202, 400, 401, 402}
    assert sum(r.length for r in found if r.doc_id == 501) == next(r.doc_tokens for r in found if r.doc_id == 501) > 4096
    assert len([i for i in ids if i is not None and (20 <= i < 26 or 300 <= i < 400)]) == 6


def test_queries_are_named_by_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "decontaminate", "pack"]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, build in queries.QUERIES.items():
        if name not in ("op2_chat_format", "op4_decontamination"):
            assert build(spark, str(tmp_path)).count() == 0, name
