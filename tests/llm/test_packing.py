import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lectern.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, row string, bin int, start string"
plain = Tokenizer.from_file(PATH)
units = packing.UnitTokenizer(PATH)


def encode(text):
    return plain.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["it's", "''s", "&'t", "a,b", "x'll.", "3.14", "é", ",̧c", " ", "<|endoftext|>", "<|", "ﬁ", "İ", "Σ", " "])), max_size=12).map("".join))
def test_ids_equal_the_tokenizers(text):
    text = text.encode("utf-8", "ignore").decode()
    assert next(iter(units(pa.array([text])))).tolist() == encode(text)


def test_cache_may_run_over(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_UNITS", 5)
    own = packing.UnitTokenizer(PATH)
    texts = [f"some words {i} here, again {i % 3}" for i in range(30)]
    for text in texts:
        assert next(iter(own(pa.array([text])))).tolist() == encode(text)


def test_pieces_cover_every_document(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    texts = [("word%d " % (i % 17)) * (i * 7 % 300) for i in range(200)] + [None, "", "long text, " * 9000, "end" * 3]
    rows = [(i, t, "r", 1, "s") for i, t in enumerate(texts)] + [(None, "null id", "", 1, ""), (3, texts[3], "", 1, "")]
    found = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH).collect()
    pieces = {}
    for r in found:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for doc_id, text, *_ in rows:
        ids = np.array([*encode(text), 2], "<u4")
        own = sorted({(r.start, r.length, r.ids_crc32) for r in pieces[doc_id, len(ids)]})
        assert [s for s, _, _ in own] == list(range(0, len(ids), 4096))
        for start, length, crc in own:
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc and length <= 4096
        assert sum(n for _, n, _ in own) == len(ids)
    assert sum(r.doc_id == 3 for r in found) == 2
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


@pytest.mark.parametrize("seed", [1, 2])
def test_little_padding_and_balanced_cost(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(np.minimum(4096, rng.lognormal(6, 1, 3000)).astype(int) + 1)[::-1]
    lengths = np.minimum(lengths, 4096)
    sequence, _ = packing.assign(lengths)
    used = np.bincount(sequence, lengths)
    assert used.max() <= 4096 and 1 - used.sum() / (len(used) * 4096) < 0.02


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
