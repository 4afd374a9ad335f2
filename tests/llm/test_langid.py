import corpus_pipeline
import numpy as np
import pyarrow as pa
from lectern.llm import langid

SCHEMA = "doc_id long, text string, lang string, score int, row string"


def docs(spark, n=400):
    words = {"aa": "foo bar baz qux ", "bb": "über straße grün ñandú ", "cc": "zzz yyy xxx "}
    rows = [(i, words[k] * (1 + i % 30), k, 1, "r") for i in range(n) for k in [list(words)[i % 3]]]
    rows += [(1000, None, "aa", 1, None), (1001, "", None, 1, None), (1002, "123 456 !!", "bb", 1, None), (None, "foo bar", None, 1, None)]
    rows += [(1003, "über straße grün ñandú " * 20_000, None, 1, None), (1, words["bb"], "aa", 1, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_held_out_accuracy_and_defined_cases(spark):
    given = docs(spark)
    found = {r.doc_id: r for r in langid.identify(given).collect()}
    truth = {r.doc_id: r.lang for r in given.collect() if r.doc_id and 1 < r.doc_id < 1000}
    held = [k for k in truth if found[k].held_out]
    assert 0.15 * len(truth) < len(held) < 0.35 * len(truth)
    assert np.mean([found[k].lang_pred == truth[k] for k in held]) > 0.97
    assert all(found[k].lang_pred == "und" and found[k].score == 0 for k in (1000, 1001, 1002))
    assert found[None].lang_pred == "aa" and found[1003].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in found.values())


def test_prediction_equals_a_plain_pass_and_ignores_labels(spark):
    given = docs(spark, 90)
    net = langid.train(given)
    rows = {r.doc_id: r for r in langid.predict(given, net, ["doc_id"]).collect()}
    for r in given.collect():
        if r.text and r.doc_id and r.doc_id > 1 and r.doc_id < 1000:
            x, _, size = langid.windows(pa.array([r.text]))
            assert size.sum() == len(r.text.encode())
            features, _ = net.features(x)
            logits = features @ net.out + net.out_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p = ((p / p.sum(1, keepdims=True)) * size[:, None]).sum(0) / size.sum()
            assert abs(rows[r.doc_id].score - p.max()) < 1e-4


def test_nothing_to_learn_and_empty_table(spark):
    none = spark.createDataFrame([(1, "text", None, 1, None)], SCHEMA)
    assert langid.identify(none).first().lang_pred == "und"
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_gradient_matches_differences():
    net = langid.ByteNet(["a", "b"])
    for p in net.parameters():
        p += np.random.default_rng(0).normal(0, 0.1, p.shape).astype(np.float32)
    x = np.random.default_rng(1).integers(0, 256, (6, 20)).astype(np.uint8)
    y = np.array([0, 1, 0, 1, 1, 0])

    def loss():
        return -np.log(net.probabilities(x)[np.arange(6), y].astype(float)).mean()

    for p, g in zip(net.parameters(), net.gradients(x, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_drop_unidentified(spark, tmp_path):
    docs(spark, 60).write.parquet(str(tmp_path / "d"))
    given = spark.read.parquet(str(tmp_path / "d"))
    kept = langid.drop_unidentified(given)
    assert kept.columns == given.columns
    assert sorted(set(r.doc_id for r in given.collect() if r.doc_id) - set(r.doc_id for r in kept.collect() if r.doc_id)) == [1000, 1001, 1002]


def test_short_texts_and_rare_languages_are_learned(spark):
    rows = [(i, "foo bar baz qux " * 400, "aa", 1, "r") for i in range(600)]
    rows += [(10_000 + i, "ñandú grün", "bb", 1, "r") for i in range(40)]
    given = spark.createDataFrame(rows, SCHEMA).repartition(3)
    net = langid.train(given, most=400)
    assert net.languages == ["aa", "bb"]
    found = langid.predict(given, net, ["doc_id", "lang"])
    assert found.filter("lang_pred <> lang").count() == 0


def test_every_language_has_its_windows():
    assert langid._quotas({"a": 10**9, "b": 3, "c": 10**6}, 1000) == {"b": 3, "c": 498, "a": 499}
    assert set(langid._quotas({str(i): 5 for i in range(50)}, 20).values()) == {1}


def test_nothing_learned_drops_letterless_texts_only(spark, tmp_path):
    rows = [(0, "short text", None, 1, "r"), (1, "123", None, 1, "r"), (2, None, None, 1, "r"), (3, "x" * 200, "", 1, "r")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "none"))
    kept = langid.drop_unidentified(spark.read.parquet(str(tmp_path / "none")), least_score=0.5)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3]


def test_the_network_rejects_texts_that_it_gives_no_language(spark, tmp_path):
    mixed = "foo bar baz qux " * 40 + "über straße grün ñandú " * 28 + "zzz yyy xxx " * 53
    rows = [(2000 + i, mixed, None, 1, "mixed") for i in range(3)]
    docs(spark, 90).union(spark.createDataFrame(rows, SCHEMA)).write.parquet(str(tmp_path / "d"))
    given = spark.read.parquet(str(tmp_path / "d"))
    scores = [r.score for r in langid.identify(given).filter("doc_id >= 2000").collect()]
    assert len(scores) == 3 and all(0.3 < s < 0.5 for s in scores)
    for kept in (langid.drop_unidentified(given), corpus_pipeline.identify_language(spark, given, str(tmp_path))):
        found = [r.doc_id for r in kept.collect()]
        assert not {1000, 1001, 1002, 2000, 2001, 2002} & set(found) and len(found) == given.count() - 6
    assert langid.drop_unidentified(given, least_score=0.0).count() == given.count() - 3
