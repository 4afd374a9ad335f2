import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from lectern.llm import recurrent_lm as lm
from lectern.llm.words import gathered

SCHEMA = "doc_id long, text string, row string, held_out int, tail string"


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", lowered) if w] + [None]


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def corpus(n=400, seed=1):
    """Two languages: a text's words tell which words follow."""
    rng = random.Random(seed)
    kinds = [[f"{k}{i}" for i in range(40)] for k in "abé"]
    rows = []
    for i in range(n):
        words = rng.choice(kinds)
        rows.append((i, " ".join(rng.choice(words).upper() if rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randint(0, 60)))))
    rows += [(1000, None), (1001, ""), (1002, "\n"), (1003, "Zz never"), (None, "a1 a2"), (7, rows[7][1]), (1004, "a1 b2 " * 20_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "r", 1, "x") for d, t in rows], SCHEMA).repartition(3)


def test_counts_and_base_equal_brute_force(spark):
    rows = corpus()
    for most in (lm.HEAD, 30):
        found = lm.score(frame(spark, rows), most=most).collect()
        assert len(found) == len(rows)
        by_id = {(r.doc_id, r.n_tokens): r for r in found}
        count = Counter(t for d, text in rows if not held(d) for t in tokens(text))
        n, v = sum(count.values()), len(count)
        for doc_id, text in rows:
            own, r = tokens(text), by_id[doc_id, len(tokens(text))]
            assert r.held_out == held(doc_id) and r.train_tokens == n
            assert r.n_known == sum(count[t] > 0 for t in own)
            base = sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
            assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
            assert r.score < 0


def test_held_out_scores_beat_the_base(spark):
    found = [r for r in lm.score(frame(spark, corpus(3000, 2))).collect() if r.held_out and 20 < r.n_tokens < 1000]
    assert sum(r.score for r in found) > sum(r.base_score for r in found) + 0.1 * sum(r.n_tokens for r in found)


def test_probabilities_sum_to_one():
    for side in (1, 7, 40):
        net = lm.Net(side)
        states = np.random.default_rng(0).normal(0, 1, (lm.HIDDEN, 5)).astype(np.float32)
        total = sum(np.exp(lm.log_likelihood(net, states, np.full(5, t))) for t in range(net.other + 1))
        assert np.allclose(total, 1, atol=1e-4)


def test_large_and_small_logits_give_the_same_as_a_plain_softmax():
    rng = np.random.default_rng(6)
    for scale in (0.3, 300):
        net = lm.Net(24, rng.normal(0, scale, lm.Net(24).flat.shape).astype(np.float32))
        states = rng.uniform(-1, 1, (lm.HIDDEN, 3000)).astype(np.float32)
        ids = rng.integers(0, net.other + 1, 3000)
        want = np.empty(3000)
        for i, (state, token) in enumerate(zip(states.T.astype(np.float64), ids.tolist(), strict=True)):
            kind, word = divmod(token, 24)
            logits = [(net.c.T @ state + net.cb, kind)] + ([(net.o[kind].T @ state + net.ob[kind], word)] if kind < 24 else [])
            want[i] = sum(z[own] - z.max() - np.log(np.exp(z - z.max()).sum()) for z, own in logits)
        assert np.allclose(lm.log_likelihood(net, states, ids), want, rtol=1e-4, atol=1e-3)


def test_logits_over_classes_are_held_for_a_bounded_number_of_tokens():
    net = lm.Net(120)
    states, ids = np.zeros((lm.HIDDEN, 1 << 16), np.float32), np.random.default_rng(7).integers(0, net.other, 1 << 16)
    tracemalloc.start()
    lm.log_likelihood(net, states, ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 121 * 4 << 16


def test_the_vocabulary_grows_with_the_corpus():
    assert [lm.side_for(v) for v in (0, 1, 24**4, 24**4 + 1, 10**8)] == [24, 24, 24, 25, 100]


def test_positions_of_tokens_equal_a_search(spark):
    rng = np.random.default_rng(8)
    held = np.unique(np.concatenate([rng.integers(0, 1 << 64, 5000, np.uint64), (np.arange(50) + 7).astype(np.uint64), [np.uint64(2**64 - 1)]]))
    frame = spark.createDataFrame([(int(t), 1) for t in held.view(np.int64)], "token long, n long")
    vocabulary, _ = lm.head_of(frame)
    asked = np.concatenate([held, rng.integers(0, 1 << 64, 5000, np.uint64), np.arange(100, dtype=np.uint64)])
    at, known = vocabulary.look_up(asked)
    assert (known == np.isin(asked, held)).all() and (vocabulary.tokens[at[known]] == asked[known]).all()


def test_state_is_carried_across_windows_and_reset_between_documents():
    rng = np.random.default_rng(3)
    lengths = [1, 200, 3, 77, 64, 1, 900]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    net = lm.Net(26)
    ids = rng.integers(0, net.other + 1, bounds[-1]).astype(np.int64)
    found = lm.score_on(net, ids, bounds)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        source = np.concatenate([[net.start], ids[a : b - 1]])[:, None]
        states = lm.recur(net, source, np.zeros((lm.HIDDEN, 1), np.float32))
        assert abs(found[i] - lm.log_likelihood(net, states[:, :, 0], ids[a:b]).sum()) < 1e-2


def test_gradient_matches_differences():
    rng = np.random.default_rng(4)
    bounds = np.array([0, 9, 14, 30])
    side = 24
    net = lm.Net(side, (rng.normal(0, 0.4, lm.Net(side).flat.shape)).astype(np.float32))
    ids = rng.integers(0, net.other + 1, 30)
    lanes = lm.lay_out(ids, bounds, 2, net.start)
    zero = np.zeros((lm.HIDDEN, lanes.target.shape[1]), np.float32)

    def loss():
        part, grad, _, n = lm.gradient(net, lanes, 0, len(lanes.target), zero)
        return part / n, grad

    _, grad = loss()
    for name in ("x", "u", "c", "cb", "o", "ob"):
        at = np.abs(getattr(lm.Net(side, grad), name)).argmax()
        view = getattr(net, name).reshape(-1)
        old = view[at]
        view[at] = old + 3e-2
        up = loss()[0]
        view[at] = old - 3e-2
        down = loss()[0]
        view[at] = old
        want = getattr(lm.Net(side, grad), name).reshape(-1)[at]
        assert abs((up - down) / 6e-2 - want) < 0.05 * abs(want) + 1e-4


def test_averaging_in_levels(spark, monkeypatch):
    monkeypatch.setattr(lm, "MERGED", 2)
    texts = spark.createDataFrame([(i, f"a b c {i}") for i in range(64)], "row long, text string").repartition(5)
    vocabulary, _ = lm.head_of(lm.count_tokens(texts))
    net, losses = lm.train(texts, vocabulary, 10, ((1.0, 0.01),))
    assert np.isfinite(net.flat).all() and len(losses) == 1


def test_nothing_to_learn_and_empty_table(spark):
    assert lm.score(frame(spark, [])).count() == 0
    row = lm.score(frame(spark, [(None, "never seen")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_tokens_follow_the_separators():
    found, bounds = lm.tokenise(pa.array(["A b", None, " c "]))
    assert bounds.tolist() == [0, 3, 4, 6] and (found[[2, 3, 5]] == lm.END).all()


def test_small_batches_are_gathered_whole_and_in_order():
    texts = ["a" * n for n in (5, 0, 90, 3, 3, 400, 1)] + [None, "z"]
    given = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t], pa.string())], names=["row", "text"]) for i, t in enumerate(texts)]
    found = list(gathered(given, "text", 120))
    assert [(r["row"], r["text"]) for b in found for r in b.to_pylist()] == list(enumerate(texts))
    assert 1 < len(found) < len(texts) and all(b.num_rows == 1 or b.column("text").nbytes <= 120 for b in found)
    assert list(gathered([], "text", 120)) == []


def test_classes_of_unlike_sizes_are_grouped_whole_and_give_the_gradient():
    rng = np.random.default_rng(9)
    net = lm.Net(24, rng.normal(0, 0.4, lm.Net(24).flat.shape).astype(np.float32))
    ids = np.where(rng.random(4000) < 0.4, rng.integers(0, 24, 4000), (rng.zipf(1.5, 4000) * 7) % (net.other + 1))
    order, n, classes = lm._by_class(net, np.append(ids, [-1, -1]))
    assert n == 4000 and sorted(order[n:].tolist()) == [4000, 4001]
    groups = list(lm._groups(classes))
    assert len(groups) < len(classes) / 2
    taken = sorted(np.concatenate([at[real] for _, at, real in groups]).tolist())
    assert taken == list(range(int((ids < net.other).sum())))
    lanes = lm.lay_out(ids, np.arange(0, 4001, 100), 40, net.start)
    loss, grad, h, _ = lm.gradient(net, lanes, 0, 100, np.zeros((lm.HIDDEN, 40), np.float32))
    states = lm.recur(net, lanes.source, np.zeros((lm.HIDDEN, 40), np.float32))
    assert np.array_equal(h, states[:, -1])
    flat, tokens = states.reshape(lm.HIDDEN, -1), lanes.target.ravel()
    assert abs(loss + lm.log_likelihood(net, flat, tokens).astype(np.float64).sum()) < 1e-3 * loss
    want = np.zeros((24, 24))
    for k in range(24):
        own = tokens // 24 == k
        logits = flat[:, own].T @ net.o[k] + net.ob[k]
        p = np.exp(logits - logits.max(1, keepdims=True))
        want[k] = (p / p.sum(1, keepdims=True)).sum(0) - np.bincount(tokens[own] % 24, minlength=24)
    assert np.allclose(lm.Net(24, grad).ob, want / 4000, atol=1e-5)


def test_steps_equal_the_usual_means_of_gradients_and_squares():
    rng = np.random.default_rng(10)
    net = lm.Net(24)
    adam, want = lm.Adam(net, 0.01), net.flat.astype(np.float64)
    first = second = np.zeros_like(want)
    for step in range(1, 6):
        grad = rng.normal(0, 10.0 ** rng.integers(-6, 0), len(want)).astype(np.float32)
        adam.update(grad, 0.7)
        grad = grad.astype(np.float64) / max(1, np.sqrt((grad.astype(np.float64) ** 2).sum()))
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        want = want - 0.01 * 0.7 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    assert np.allclose(net.flat, want, atol=2e-5)


def test_documents_of_several_chunks_are_scored_side_by_side(monkeypatch):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(200, 3)[:205])]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in rows]), pa.array([i for i, _ in rows]), pa.array([False] * len(rows)), pa.array([t for _, t in rows], pa.string())],
        names=["doc_id", "row", "held_out", "text"],
    )
    none = np.zeros(0, np.int64)
    vocabulary = lm.Vocabulary(none.astype(np.uint64), none, none.astype(np.int32), 24, np.zeros(1 << lm.PREFIX, np.int32))
    flat, calls, found = lm.Net(24).flat, [], {}
    plain = lm.score_on
    monkeypatch.setattr(lm, "score_on", lambda *a: calls.append(1) or plain(*a))
    monkeypatch.setattr(lm, "CHUNK_BYTES", 1000)
    for scored in (1 << 22, 1, 900):
        monkeypatch.setattr(lm, "SCORED", scored, raising=False)
        out = list(lm._scorer(flat, vocabulary)([batch]))
        assert len(out) > 5 and [i for b in out for i in b.column("doc_id").to_pylist()] == [i for i, _ in rows]
        found[scored] = np.concatenate([b.column("net_log").to_numpy() for b in out])
        if scored == 1 << 22:
            assert len(calls) == 1
    assert np.allclose(found[1], found[900], rtol=1e-4) and np.allclose(found[1], found[1 << 22], rtol=1e-4)
