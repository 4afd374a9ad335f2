"""Work that is done once, or not at all where nothing can come of it."""

import random

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import arrow
from lectern.operators import embedding, postings, retrieval
from lectern.plans.text import offsets_loader, word_offsets_loader
from lectern.session import scratch_path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_where_texts_lie(spark, monkeypatch):
    seen, stored = {}, postings.stored
    monkeypatch.setattr(postings, "stored", lambda df, path: seen.setdefault(path.rsplit("/", 1)[1].split("-")[0], plan(df)) and stored(df, path))
    texts = [(i, f"word{i % 7} shared shared w{i}") for i in range(600)] + [(600, None), (601, "")]
    items = spark.createDataFrame(texts, "item_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "shared word3"), (2, "w5 absent"), (3, "")], "query_id long, text string")
    index = postings.postings_store(items, scratch_path(spark, "postings"), block_postings=16)
    assert "hashpartitioning" not in seen["weighed"]
    shape = lambda df: sorted((r.query_id, r.item_id, r["rank"], round(r.score, 6)) for r in df.collect())
    want = shape(retrieval.bm25(items, asked, 5))
    assert want and shape(postings.bm25_stored(index, asked, 5)) == want
    monkeypatch.setattr(postings, "SENT_ROWS", 0)
    assert shape(postings.bm25_stored(index, asked, 5)) == want


def test_postings_of_ids_that_repeat(spark):
    rows = [(1, "a b"), (1, "a c"), (1, "a b c"), (None, "b"), (None, "b"), (2, "a a")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    index = postings.postings_store(items, scratch_path(spark, "postings"))
    found = index.blocks.select("term", F.explode(F.arrays_zip("items", "tf", "length")).alias("p")).select("term", "p.*").collect()
    want = [("a", 1, 2, 2), ("b", 1, 1, 2), ("c", 1, 1, 2), ("a", 1, 1, 3), ("b", 1, 1, 3), ("c", 1, 1, 3), ("b", None, 2, 1), ("a", 2, 2, 2)]
    assert sorted(map(str, [(r.term, r["items"], r.tf, r.length) for r in found])) == sorted(map(str, want))


def test_sections_by_title_are_written_once(spark):
    chunks = spark.range(40).select(
        F.concat(F.lit("t"), F.col("id") % 3).alias("section_title"), F.col("id").alias("source_file"), F.lit(0).alias("chunk_index"), F.lit("s").alias("summary")
    )
    found = embedding.section_summaries(chunks, by="title")
    assert "Range (" not in plan(found) and found.count() == 40


def test_long_patterns_search_only_texts_that_hold_what_they_need():
    class Searched:
        size = 0

        def __init__(self, pattern):
            self.pattern = pattern

        def finditer(self, text):
            Searched.size += len(text)
            return self.pattern.finditer(text)

    patterns = {sub: p for p, sub in [(p, s) for p, s, _ in arrow._entity_rules("default")["company"]]}
    import re

    pattern = re.compile(patterns["company_suffix"])
    texts = ["Aa " * 500, "The Good Company Ltd and Other Things Inc", "", "GmbH", "Xy SA\x00Zw Corporation", "Blue SARL\nRed"]
    batch = arrow._Batch(texts)
    got = arrow._search_where(batch, Searched(pattern), arrow._NEEDED["company_suffix"])
    assert Searched.size < 500
    shape = lambda found: sorted(zip(*[f.tolist() for f in found]))
    assert shape(got) == shape(batch.search(pattern)) and shape(got)


def test_offsets_of_words_equal_those_of_whole_texts(monkeypatch):
    monkeypatch.setattr(arrow, "CACHED_WORDS", 50)
    whole, words = offsets_loader()(), word_offsets_loader()()
    assert not words.whole
    rng = random.Random(3)
    pieces = [*"ab's.,'é́ \t\n\x0b\x1c\x85İßΣ好😀👩‍12<|>", "<|endoftext|>", "'ll", "  ", "don't", " "]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        assert np.array_equal(words(text), np.asarray(whole(text), dtype=np.int64).reshape(-1, 2)), text
