import math

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import chunking, cleaning, filters, questions


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string").coalesce(1)


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_pii_masks_run_in_order(spark):
    df = texts(
        spark,
        "Contact me at john.doe@example.com or call 22 123 456",
        "My ID is 12345678 and IBAN is TN5914207000000012345678901",
        "+216 22 123 456",
        "12345678",
        None,
        "",
    )
    masked = cleaning.mask_pii(df)
    assert column(masked, "text") == [
        "Contact me at [EMAIL] or call [PHONE]",
        "My ID is [PHONE] and IBAN is [IBAN]",  # phone runs before the national id
        "+[PHONE]",  # the leading plus survives
        "[PHONE]",
        None,
        "",
    ]
    assert column(masked, "phone_hits") == [1, 1, 1, 1, None, 0]
    assert column(masked, "national_id_hits")[:4] == [0, 0, 0, 0]
    only = cleaning.mask_pii(df, types=["national_id"])
    assert column(only, "text")[3] == "[ID]"


def test_masking_is_idempotent(spark):
    df = texts(spark, "a@b.co 22123456 TN5914207000000012345678901", "é22123456", "x 22-123-456.")
    once = cleaning.mask_pii(df).select("id", "text")
    assert column(once, "text") == column(cleaning.mask_pii(once), "text")
    assert column(once, "text")[1] == "é22123456"  # é is a word character: no boundary


def test_whitespace_and_tokens(spark):
    df = texts(spark, "Hello    world\n\ttest", "  a b\x1cc ", "", None)
    assert column(cleaning.normalize_whitespace(df), "text") == ["Hello world test", "a b c", "", None]
    assert column(cleaning.count_tokens(df), "token_count") == [3, 3, 0, 0]
    assert column(cleaning.count_tokens(df, method="character"), "token_count")[2:] == [0, 0]
    with pytest.raises(ValueError):
        X.token_count(F.col("text"), "syllable")


def test_nfkc(spark):
    df = texts(spark, "café", "ﬁne ①", "plain", None)
    assert column(cleaning.normalize_unicode(df), "text") == ["café", "fine 1", "plain", None]


def test_language(spark):
    df = texts(spark, "This is the handbook of the school", "هذا سؤال باللغة العربية", "Quel est le prérequis pour le cours de finance?", "  ", "12 34")
    assert column(cleaning.detect_language(df), "language") == ["en", "ar", "fr", "unknown", "unknown"]


def test_truncate_keeps_short_texts_as_they_are(spark):
    df = texts(spark, "a  b c", "a b c d e")
    assert column(cleaning.truncate_tokens(df, "text", 3), "text") == ["a  b c", "a b c"]


def test_summary(spark):
    df = texts(spark, "One sentence.", "First one. Second one.", "x" * 150, "", "  What?! Yes ")
    assert column(cleaning.simple_summary(df), "summary") == [
        "One sentence..",  # a single sentence keeps its mark and gets another
        "First one.",
        "x" * 100 + "...",
        ".",
        "What.",
    ]


def test_keywords_ties_by_first_occurrence(spark):
    df = texts(spark, "The beta alpha beta of alpha gamma it", None)
    rows = cleaning.extract_keywords(df, "id", k=2).orderBy("rank").collect()
    assert [(r["word"], r["count"], r["rank"]) for r in rows] == [("beta", 2, 1), ("alpha", 2, 2)]


def test_preprocess_blank(spark):
    row = cleaning.preprocess(texts(spark, None)).first()
    assert (row["text"], row["original_length"], row["token_count"], row["language"], row["pii_masked"]) == ("", 0, 0, "unknown", False)


def test_intents(spark):
    df = texts(
        spark,
        "What are the prerequisites for BCOR 260?",
        "Summarize the curriculum handbook",
        "Please show me the list of data and give me a table",
        "Give me a summary, a brief overview: what is the main point",
        "When does the fall semester start in 2024?",
        "",
        "nothing here",
    )
    rows = questions.classify_intent(df).orderBy("id").collect()
    assert [r["intent"] for r in rows] == ["qa", "other", "extract_structured", "summarize", "qa", "other", "other"]
    # One of three patterns stays below the threshold but keeps its confidence.
    assert math.isclose(rows[1]["intent_confidence"], 1 / 3)
    assert rows[5]["intent_confidence"] == 0.0


def entity_set(spark, text, **options):
    rows = questions.extract_entities(texts(spark, text), "id", **options).collect()
    return {(r["type"], r["subtype"], r["value"]) for r in rows}


def test_entities(spark):
    found = entity_set(spark, "Invoice #12345 dated 2024-01-15 for $1,500 from Google LLC, call +216 22 123 456")
    assert ("date", "iso_date", "2024-01-15") in found
    assert ("invoice_number", "hash_invoice", "#12345") in found
    assert ("amount", "currency", "$1,500") in found
    assert ("company", "company_suffix", "Google LLC") in found
    assert ("phone", "international_phone", "+216 22 123 456") in found
    reference = entity_set(spark, "see #12345 for two words", rules="reference")
    assert not any(s == "hash_invoice" for _, s, _ in reference)  # "#" needs a word character before it
    assert any(s == "capitalized_entity" for _, s, _ in reference)  # any two words match without case


def test_overlapping_entities_keep_the_first(spark):
    rows = questions.extract_entities(texts(spark, "1,500 TND and 15.01.2024"), "id")
    amounts = [(r["value"], r["subtype"]) for r in rows.filter("type = 'amount'").orderBy("start").collect()]
    assert amounts[0] == ("1,500 TND", "currency")
    spans = [(r["type"], r["start"], r["end"]) for r in rows.orderBy("type", "start").collect()]
    for (k1, _, e1), (k2, s2, _) in zip(spans, spans[1:]):
        assert k1 != k2 or s2 >= e1


def test_entity_counts(spark):
    found = questions.extract_entities(texts(spark, "a@b.co and c@d.org on 2024-01-15"), "id")
    row = questions.entity_counts(found, "id").first()
    assert (row["email"], row["date"], row["company"]) == (2, 1, 0)
    assert row["entity_count"] == found.count()


def test_question_records(spark):
    df = spark.createDataFrame([("Contact me at a@b.co about 12 TND?", "u1"), ("  ", None)], "question string, user_id string")
    full, empty = sorted(questions.make_question_records(df).collect(), key=lambda r: r["original_question"], reverse=True)
    assert full["processed_question"] == "Contact me at [EMAIL] about 12 TND?"
    assert full["entities"]["amount"][0]["value"] == "12 TND"
    assert full["preprocessing"]["pii_masked"] is True
    assert empty["intent"] == "unknown" and empty["preprocessing"]["error"] == "Empty question"
    assert empty["processed_question"] == "  " and empty["preprocessing"]["token_count"] == 0
    assert filters.validate_questions(questions.make_question_records(df)).filter("valid").count() == 2


def test_question_validation(spark):
    good = "a1b2c3d4-e5f6-7890-abcd-ef1234567890"
    rows = [
        (good, "2024-01-15T10:00:00.123456Z", "q", "q", None),
        ("{urn:uuid:" + good.replace("-", "") + "}", "2024-01-15", "q", "q", None),
        ("a1b2", "2024-01-15T10:00:00Z", "q", "q", "question_id is no UUID"),
        (good, "2024", "q", "q", "timestamp is not ISO"),
        (good, "2024-13-01T00:00:00", "q", "q", "timestamp is not ISO"),
        (good, None, "q", None, "missing timestamp, processed_question"),
    ]
    df = spark.createDataFrame(rows, "question_id string, timestamp string, original_question string, processed_question string, expected string")
    for r in filters.validate_questions(df).collect():
        assert r["reason"] == r["expected"] and r["valid"] == (r["expected"] is None)


@pytest.mark.parametrize("n", [0, 1, 462, 463, 512, 513, 924, 925])
def test_window_counts(spark, n):
    df = texts(spark, " ".join(f"t{i}" for i in range(n)))
    rows = chunking.chunk_tokens(df).orderBy("window_idx").collect()
    assert len(rows) == math.ceil(n / 462)
    # Chunks without their overlaps give the tokens back.
    rebuilt = []
    for r in rows:
        rebuilt += r["chunk"].split()[: 462 if r is not rows[-1] else None]
    assert rebuilt == [f"t{i}" for i in range(n)]


def test_overlap_must_be_smaller_than_the_window(spark):
    with pytest.raises(ValueError):
        chunking.chunk_tokens(texts(spark, "a"), max_tokens=50, overlap=50)


def test_plugged_tokenizer(spark):
    letters = chunking.Tokenizer(lambda c: F.split(c, ""), lambda t: F.array_join(t, ""))
    rows = chunking.chunk_tokens(texts(spark, "abcdef"), max_tokens=4, overlap=1, tokenizer=letters).orderBy("window_idx").collect()
    assert [r["chunk"] for r in rows] == ["abcd", "def"]


def test_loaded_tokenizer(spark):
    def load():
        class Codes:
            def encode(self, texts):
                return [[ord(c) for c in t] for t in texts]

            def decode(self, ids):
                return ["".join(chr(i) for i in row) for row in ids]

        return Codes()

    tokenizer = chunking.plugged_tokenizer(load)
    rows = chunking.chunk_tokens(texts(spark, "abcdef", None), max_tokens=4, overlap=1, tokenizer=tokenizer).collect()
    assert sorted((r["id"], r["window_idx"], r["chunk"], r["n_tokens"]) for r in rows) == [(0, 0, "abcd", 4), (0, 1, "def", 3)]
    counted = cleaning.count_tokens(texts(spark, "abc"), method=tokenizer.encode(F.col("text")))
    assert column(counted, "token_count") == [3]


def test_proposed_splits(spark):
    df = spark.createDataFrame([(1, [str(i) for i in range(25)]), (2, ["a"] * 10), (3, [])], "id int, pieces array<string>")

    def failing():
        def ask(part):
            raise RuntimeError

        return ask

    even = df.select("id", chunking.even_splits(F.col("pieces")).alias("s"), chunking.proposed_splits(F.col("pieces"), failing).alias("f"))
    found = {r["id"]: (r["s"], r["f"]) for r in even.collect()}
    assert found[1] == ([0, 10, 20], [0, 10, 20]) and found[2] == ([0], [0])
    silent = df.select("id", chunking.proposed_splits(F.col("pieces"), lambda: lambda part: []).alias("f")).filter("id = 1").first()
    assert silent["f"] == [0, 10, 17]  # half of 20 pieces, then half of 15
    asked = df.select("id", chunking.proposed_splits(F.col("pieces"), lambda: lambda part: [3, 7]).alias("f")).filter("id = 1").first()
    assert asked["f"] == [0, 3, 7, 10, 14, 17, 21]


def test_proposed_splits_reach_the_last_piece(spark):
    df = spark.createDataFrame([([str(i) for i in range(2000)],)], "pieces array<string>")
    cuts = df.select(chunking.proposed_splits(F.col("pieces"), lambda: lambda part: [3, 7]).alias("f")).first()["f"]
    assert cuts == [0, *(c for k in range(285) for c in (7 * k + 3, 7 * k + 7) if 2000 - 7 * k > 10)]


def test_entities_are_unescaped_but_markup_is_not_made(spark):
    df = texts(spark, "caf&eacute; &#8217;x&#x2019; &lt;b&gt; &amp; &unknown; &", "plain", None)
    assert column(cleaning.unescape_entities(df), "text") == ["café ’x’ &lt;b&gt; &amp; &unknown; &", "plain", None]


def test_chunk_overlap_lengths(spark):
    df = spark.createDataFrame([("d", 0, "a b c d"), ("d", 1, "c d e"), ("d", 2, "x"), ("d", 3, "x x")], "doc string, i int, chunk string")
    rows = {r["i"]: r["overlap"] for r in chunking.chunk_overlap(df, "doc", "i").collect()}
    assert rows == {0: 2, 1: 0, 2: 1}
    chars = {r["i"]: r["overlap"] for r in chunking.chunk_overlap(df, "doc", "i", method="character").collect()}
    assert chars[0] == 3


def test_merge_at_splits(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"], [2, 9, 2])], "id int, pieces array<string>, s array<int>")
    rows = chunking.merge_at_splits(df, F.col("s")).orderBy("group_idx").collect()
    assert [r["chunk"] for r in rows] == ["a b", "c d"]


def test_semantic_splits_cut_where_words_change(spark):
    df = spark.createDataFrame([(1, ["red cat", "red dog", "blue sky", "blue sea"])], "id int, pieces array<string>")
    assert df.select(chunking.semantic_splits(F.col("pieces"), 0.2).alias("s")).first()["s"] == [0, 2]


def test_entities_of_a_batch_equal_entities_alone(spark):
    import random
    import re

    import pyarrow as pa
    from lectern.functions import arrow

    rng = random.Random(4)
    bits = ["2024-01-02", "1/2/2024", " ", "May 3, 2021", "$ 12.50", "12 EUR", "#12345", "INV-77", "a@b.org", "+216 22 333 444", "Acme Data Inc", "New York", "\n", "\x00", "é", "x", "99", "-"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(400)] + ["Foo Bar", "Baz Inc", "", "12", "34"]
    batch = arrow._Batch(texts)
    for kind, patterns in arrow._entity_rules("default").items():
        for pattern, _, flags in patterns:
            compiled = re.compile(pattern, flags)
            want = sorted((i, *m.span()) for i, t in enumerate(texts) for m in compiled.finditer(t))
            assert sorted(zip(*(c.tolist() for c in batch.search(compiled)))) == want, pattern
    # A pattern that runs over the end of a text is searched again in each text it touched.
    greedy = re.compile(r"x[^q]*")
    assert sorted(zip(*(c.tolist() for c in arrow._Batch(["ax", "bx", "q"]).search(greedy)))) == [(0, 1, 2), (1, 1, 2)]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "nothing here"), (4, "call +216 22 333 444 now")], "id int, t string")
    found = {r["id"]: r["e"] for r in df.select("id", arrow.entity_finder()(F.col("t")).alias("e")).collect()}
    assert found[1] is None and found[2] == found[3] == [] and "phone" in {e["type"] for e in found[4]}


def test_keywords_of_null_and_empty_batches(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "bb the bbb ccc bbb the a")], "doc_id int, text string").coalesce(1)
    found = [(r["doc_id"], r["rank"], r["word"], r["count"]) for r in cleaning.extract_keywords(df, "doc_id").collect()]
    assert found == [(3, 1, "bbb", 2), (3, 2, "ccc", 1)]
    assert cleaning.extract_keywords(df.filter("doc_id < 3"), "doc_id").count() == 0


def test_texts_of_any_script_and_rules_reach_the_entity_patterns(spark):
    reference = entity_set(spark, "hello there friend", rules="reference")
    assert any(s == "capitalized_entity" for _, s, _ in reference)
    for text in ("\u0661\u0662 EUR", "\uff11\uff12/\uff11/\uff12\uff10\uff12\uff11", "New\u00a0York", "New\x1fYork", "New\x85York", "Data\u3000Haus GmbH"):
        assert entity_set(spark, text), text


def test_large_batches_are_worked_on_in_parts(spark, monkeypatch):
    import pyarrow as pa

    from lectern.functions import arrow

    texts = pa.array([["a", "b"], None, [], ["c"] * 500, ["a"]], pa.list_(pa.string()))
    parts = list(arrow.bounded(texts, 64))
    assert len(parts) > 2 and pa.concat_arrays(parts).equals(texts) and list(arrow.bounded(texts[:0])) == []
    encode = arrow.hashed_counts(8).func
    whole = encode(texts)
    monkeypatch.setattr(arrow, "PART_BYTES", 64)
    assert encode(texts).equals(whole) and len(whole) == 5 and encode(texts[:0]).type == whole.type
    rows = spark.createDataFrame([(1, [f"p{i}" for i in range(9)]), (2, None), (3, [])], "id int, pieces array<string>")
    from lectern.operators import chunking

    found = {r.id: r.s for r in rows.select("id", chunking.proposed_splits(rows.pieces, lambda: lambda part: [3]).alias("s")).collect()}
    assert found == {1: [0], 2: None, 3: [0]}
