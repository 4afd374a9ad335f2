import hashlib
import re
from collections import defaultdict

from lectern.llm import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, row int, norm string"


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc_id))
    found = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1] is None, m[1] or 0))[1]
        found += [(d, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for _, d in members]
    return sorted(found, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "k", 1, "n") for d, t in rows], SCHEMA).repartition(3)


def result(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()], key=str)


def test_groups_equal_brute_force_with_a_hot_group(spark):
    rows = [(i, f"text {i % 40}" + " " * (i % 3)) for i in range(300)]
    rows += [(1000 + i, "the  hot\none" + "\t" * (i % 5)) for i in range(400)]
    rows += [(2000, None), (2001, ""), (2002, " \x0b\x0c\r"), (2003, "a\u00a0b"), (2004, "ab"), (None, "text 1"), (3000, "é" * 50_000), (3001, " " + "é" * 50_000)]
    found = exact_dedup.exact_duplicates(frame(spark, rows), parts=7)
    assert result(found) == brute(rows)
    kept = [r for r in found.collect() if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept}) == len({b[3] for b in brute(rows)})


def test_common_beginnings_spread(spark):
    rows = [(i, "the same long beginning of every text, then " + str(i // 2)) for i in range(400)]
    found = exact_dedup.exact_duplicates(frame(spark, rows), parts=8)
    assert result(found) == brute(rows)


def test_repeated_rows_keep_one(spark):
    found = exact_dedup.exact_duplicates(frame(spark, [(1, "a"), (1, "a"), (1, "a")])).collect()
    assert sorted(r.kept for r in found) == [False, False, True] and {r.group_size for r in found} == {3}


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def test_drop_keeps_every_column(spark, tmp_path):
    frame(spark, [(1, "a b"), (2, "ab"), (3, "c"), (3, "c")]).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
