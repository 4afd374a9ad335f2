"""Language-model scores of whole documents by a gated recurrent network.

Tokens are lower-cased words and one end per document. The network predicts the most frequent words,
whose number grows with the square root of the number of distinct tokens; its output softmax is
factored into as many classes as a class has words, with one class more for all other tokens, among
which a token has its smoothed share of the training counts. So the scores are log-probabilities over
the same events as the unigram base score.

Training is distributed: in each round every task trains a copy of the network on the documents it
holds, by truncated backpropagation, and the copies are averaged, weighted by tokens. Every training
document is used once, in one of the rounds. Scoring carries the state across windows, so a document is
scored as a whole however long it is.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ROW, numbered, written
from lectern.llm.words import chunks, find_words, gathered

HIDDEN = 16
# The network predicts side * side words one by one, in side classes; the least side.
SIDE = 24
# Tokens whose counts travel with every task, at most; the rest are joined.
HEAD = 1 << 18
# Leading bits of a token that its place among them is looked up by.
PREFIX = 18
STEPS = 32
# Rounds take the training documents up to these shares of a hash, each once.
ROUNDS = ((1 / 32, 0.02), (1 / 4, 0.01), (1.0, 0.004))
SMOOTHING = 0.1
END = np.uint64(0x452821E638D01377)
CHUNK_BYTES = 8 << 20
# Tokens that are scored side by side; about.
SCORED = 1 << 22
MERGED = 32


class Net:
    """Parameters of the network in one flat array, with named views.

    It predicts ``side * side`` words one by one, in ``side`` classes.
    """

    def __init__(self, side: int, flat: np.ndarray | None = None):
        self.side, self.other, self.start = side, side * side, side * side + 1
        self.shapes = {
            "x": (side * side + 2, 3 * HIDDEN),
            "u": (HIDDEN, 3 * HIDDEN),
            "c": (HIDDEN, side + 1),
            "cb": (side + 1,),
            "o": (side, HIDDEN, side),
            "ob": (side, side),
        }
        size = sum(int(np.prod(s)) for s in self.shapes.values())
        if flat is None:
            flat = np.random.default_rng(5).normal(0, 0.1, size).astype(np.float32)
        self.flat, at = flat, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n


def side_for(distinct: int) -> int:
    """Classes, and words of a class, for a number of distinct tokens: the words grow with its square root."""
    return max(SIDE, int(np.ceil(distinct**0.25)))


class Lanes(NamedTuple):
    """Documents laid out in lanes that run side by side; lanes are sorted by length."""

    target: np.ndarray  # step by lane: token, -1 behind a lane's end
    source: np.ndarray  # the token before, the start mark at a document's begin
    owner: np.ndarray
    active: np.ndarray  # lanes that have a token at each step


def lay_out(ids: np.ndarray, bounds: np.ndarray, lanes: int, start: int) -> Lanes:
    """Gives each document, longest first, to the shortest lane; a document stays in one lane."""
    lengths = np.diff(bounds)
    longest = int(lengths.max())
    lanes = max(1, min(lanes, len(lengths), 4 * int(lengths.sum()) // longest))
    heap = [(0, lane) for lane in range(lanes)]
    places = []
    for doc in np.argsort(-lengths, kind="stable").tolist():
        load, lane = heapq.heappop(heap)
        places.append((doc, lane, load))
        heapq.heappush(heap, (load + int(lengths[doc]), lane))
    loads = np.zeros(lanes, np.int64)
    for load, lane in heap:
        loads[lane] = load
    rank = np.empty(lanes, np.int64)
    rank[np.argsort(-loads, kind="stable")] = np.arange(lanes)
    steps = int(loads.max())
    target = np.full((steps, lanes), -1, np.int32)
    source = np.zeros((steps, lanes), np.int32)
    owner = np.zeros((steps, lanes), np.int32)
    for doc, lane, load in places:
        own = ids[bounds[doc] : bounds[doc + 1]]
        to = slice(load, load + len(own))
        target[to, rank[lane]] = own
        source[load, rank[lane]] = start
        source[load + 1 : load + len(own), rank[lane]] = own[:-1]
        owner[to, rank[lane]] = doc
    return Lanes(target, source, owner, (target >= 0).sum(1))


class Scratch:
    """Arrays that are used again for window after window, so that their memory is not asked for each time."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def get(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)


# The logistic function of x is 1 / (1 + exp(-x)), tanh(x) is 1 - 2 / (1 + exp(2 x)): an exponential takes a fraction
# of the time of tanh. Weights are multiplied instead of sums, which is exact. An infinite exponential gives the limit.
SIGNS = np.array([-1, -1, 2], np.float32)[:, None, None]
# Arrays, as numbers would be converted again in every step.
ONE, HALF, MINUS_TWO = (np.array(x, np.float32) for x in (1, 0.5, -2))
# States whose gradients are computed at once, so that they stay near the processor.
NEAR = 1024


def _by_gate(table: np.ndarray) -> np.ndarray:
    """Rows of all gates side by side as one table for each gate."""
    return table.reshape(len(table), 3, HIDDEN).transpose(1, 0, 2)


class Read(NamedTuple):
    """What reading a window leaves: states (step by lane by unit) and what the backward pass needs of each step."""

    states: np.ndarray
    gates: np.ndarray  # for each of the three gates step by lane by unit, the last one doubled
    n: np.ndarray


def _read(net: Net, source: np.ndarray, h: np.ndarray, scratch: Scratch, every: bool) -> Read:
    """Reads each step's source token; gates and ``n`` are those of the last step alone unless ``every`` step's are asked for.

    A state starts anew where the source is the start mark. In memory a lane's units lie side by side, as the
    rows of ``x`` do, so that nothing is transposed.
    """
    steps, lanes = source.shape
    fresh = source == net.start
    u = _by_gate(net.u) * SIGNS
    inputs = scratch.get("inputs", 3, steps, lanes, HIDDEN)
    if source.size < len(net.x):
        np.multiply(_by_gate(net.x.take(source.ravel(), axis=0)), SIGNS, inputs.reshape(3, -1, HIDDEN))
    else:
        for table, sign, own in zip(_by_gate(net.x), SIGNS, inputs, strict=True):
            np.take(table * sign, source, axis=0, out=own, mode="clip")
    kept = steps if every else 1
    states = scratch.get("states", steps, lanes, HIDDEN)
    gates, news = scratch.get("gates", kept, 3, lanes, HIDDEN), scratch.get("n", kept, lanes, HIDDEN)
    h = np.ascontiguousarray(h.T)
    with np.errstate(over="ignore"):
        for t, (step, zr_in, n_in, begins) in enumerate(zip(states, inputs[:2].swapaxes(0, 1), inputs[2], fresh.any(1).tolist(), strict=True)):
            if begins:
                h = h * ~fresh[t][:, None]
            g, n = gates[t if every else 0], news[t if every else 0]
            np.matmul(h, u, out=g)
            zr = g[:2]
            np.add(zr, zr_in, zr)
            np.exp(zr, zr)
            np.add(zr, ONE, zr)
            np.reciprocal(zr, zr)
            np.multiply(zr[1], g[2], n)
            np.add(n, n_in, n)
            np.exp(n, n)
            np.add(n, ONE, n)
            np.divide(MINUS_TWO, n, n)
            np.add(n, ONE, n)
            np.subtract(h, n, step)
            np.multiply(step, zr[0], step)
            np.add(step, n, step)
            h = step
    return Read(states, gates.swapaxes(0, 1), news)


def recur(net: Net, source: np.ndarray, h: np.ndarray, scratch: Scratch | None = None) -> np.ndarray:
    """States (unit by step by lane) after reading each step's source token; they lie in ``scratch`` if given."""
    return _read(net, source, h, scratch or Scratch(), False).states.transpose(2, 0, 1)


def unwind(net: Net, grad: Net, source: np.ndarray, h: np.ndarray, read: Read, outer: np.ndarray, scratch: Scratch) -> None:
    """Backpropagation through the steps of a window that began in the states ``h``: fills the gradients of ``x`` and ``u``.

    ``outer`` has the gradient of each state by step, lane and unit; the gradients that come through later steps are added to it.
    """
    steps, lanes = source.shape
    fresh = source == net.start
    begins = fresh.any(1).tolist()
    block = max(1, min(steps, NEAR // lanes))
    # The gradients of the gates and of the new state before its tanh are that of the state times these.
    factors, gates = scratch.get("factors", 4, block, lanes, HIDDEN), scratch.get("gate_gradients", block, 3, lanes, HIDDEN)
    before, rest = scratch.get("before", block, lanes, HIDDEN), scratch.get("rest", block, lanes, HIDDEN)
    flat = scratch.get("flat_gates", steps, lanes, 3, HIDDEN)
    back = np.ascontiguousarray(_by_gate(net.u).transpose(0, 2, 1))
    parts = scratch.get("parts", 4, lanes, HIDDEN)
    through, kept = parts[:3], parts[3]
    dh = np.zeros((lanes, HIDDEN), np.float32)
    for low in reversed(range(0, steps, block)):
        high = min(low + block, steps)
        z, r, g = read.gates[:, low:high]
        n, own = read.n[low:high], flat[low:high]
        was, other = before[: high - low], rest[: high - low]
        to_z, to_r, to_g, to_pre = to_gates = factors[:, : high - low]
        was[0] = read.states[low - 1] if low else h.T
        was[1:] = read.states[low : high - 1]
        was[fresh[low:high]] = 0
        np.subtract(ONE, z, other)
        np.multiply(n, n, to_pre)
        np.subtract(ONE, to_pre, to_pre)
        to_pre *= other
        np.subtract(was, n, to_z)
        to_z *= z
        to_z *= other
        np.multiply(to_pre, r, to_g)
        np.subtract(ONE, r, other)
        np.multiply(to_g, other, to_r)
        to_r *= g
        to_r *= HALF
        for t in range(high - 1, low - 1, -1):
            total, gate = outer[t], gates[t - low]
            np.add(total, dh, total)
            np.multiply(total, to_gates[:3, t - low], gate)
            np.multiply(total, z[t - low], kept)
            np.matmul(gate, back, out=through)
            np.add.reduce(parts, axis=0, out=dh)
            if begins[t]:
                dh *= ~fresh[t][:, None]
        own[:] = gates[: high - low].swapaxes(1, 2)
        grad.u += was.reshape(-1, HIDDEN).T @ own.reshape(-1, 3 * HIDDEN)
        np.multiply(outer[low:high], to_pre, own[:, :, 2])
    ids = source.ravel()
    order = np.argsort(ids.astype(np.min_scalar_type(net.start)), kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))
    by_token = np.take(flat.reshape(-1, 3 * HIDDEN), order, axis=0, out=scratch.get("by_token", len(ids), 3 * HIDDEN), mode="clip")
    grad.x[ids[order[first]]] = np.add.reduceat(by_token, first)


# Logits within this of zero need no shift before they are exponentiated.
CALM = 40.0
# Tokens whose softmax over classes is computed at once.
BLOCK = 2048
# Tokens whose states are held until they meet the outputs, when scoring; about.
TOGETHER = 1 << 16


def _with_one(states: np.ndarray) -> np.ndarray:
    """States with a unit that always is one, whose weights are the biases."""
    flat = np.empty((len(states), HIDDEN + 1), np.float32)
    flat[:, :HIDDEN], flat[:, HIDDEN] = states, 1
    return flat


def _outputs(net: Net) -> tuple[np.ndarray, np.ndarray, bool]:
    """Weights and biases of the classes and of each class's words, and whether no logit can be large.

    States lie between -1 and 1, so the weights of an output bound its logit.
    """
    c, o = np.concatenate([net.c, net.cb[None]]), np.concatenate([net.o, net.ob[:, None]], axis=1)
    return c, o, bool(max(np.abs(c).sum(0).max(), np.abs(o).sum(1).max()) < CALM)


def _softmax(weights: np.ndarray, flat: np.ndarray, own: np.ndarray, calm: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The log-probability of each token's own output, and exponentials of all its logits with their sum."""
    p = weights.T @ flat.T
    if not calm:
        p -= p.max(0)
    log = p[own, np.arange(len(own))]
    np.exp(p, out=p)
    total = p.sum(0)
    log -= np.log(total)
    return log, p, total


def _by_class(net: Net, tokens: np.ndarray) -> tuple[np.ndarray, int, list[tuple[int, slice]]]:
    """An order of the tokens by class, those below zero last, how many are others, and the place of each class of words in it."""
    signed, unsigned = (np.int8, np.uint8) if net.side < 127 else (np.int16, np.uint16)
    kind = (tokens // net.side).astype(signed).view(unsigned)
    order = np.argsort(kind, kind="stable")
    edges = np.cumsum(np.bincount(kind, minlength=net.side + 1)[: net.side + 1]).tolist()
    return order, edges[-1], [(c, slice(a, b)) for c, (a, b) in enumerate(zip([0, *edges], edges[:-1], strict=False)) if a < b]


# Classes join a group while they have this share of the tokens of its largest one, or few.
ALIKE, FEW = 0.5, 16


def _groups(classes: list[tuple[int, slice]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Classes with like numbers of tokens together: their numbers, and places of their tokens, padded to the largest, with what is real."""
    ranked = sorted(((at.stop - at.start, at.start, k) for k, at in classes), reverse=True)
    low = 0
    while low < len(ranked):
        most = ranked[low][0]
        high = low + 1
        while high < len(ranked) and (most <= FEW or ranked[high][0] >= ALIKE * most):
            high += 1
        sizes, starts, numbers = np.array(ranked[low:high]).T
        step = np.arange(most)
        real = step < sizes[:, None]
        yield numbers, starts[:, None] + np.minimum(step, sizes[:, None] - 1), real
        low = high


def _blocks(begin: int, end: int) -> list[slice]:
    return [slice(low, min(low + BLOCK, end)) for low in range(begin, end, BLOCK)]


def log_likelihood(net: Net, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Natural log-probability of each token (of its class alone for the class of all others)."""
    order, _, classes = _by_class(net, tokens)
    tokens, flat = tokens[order], _with_one(states.T.take(order, axis=0))
    kind, word = tokens // net.side, tokens % net.side
    c, o, calm = _outputs(net)
    own = np.empty(len(tokens), np.float32)
    for at in _blocks(0, len(tokens)):
        own[at] = _softmax(c, flat[at], kind[at], calm)[0]
    for k, all_of in classes:
        for at in _blocks(all_of.start, all_of.stop):
            own[at] += _softmax(o[k], flat[at], word[at], calm)[0]
    found = np.empty_like(own)
    found[order] = own
    return found


def gradient(net: Net, lanes: Lanes, low: int, high: int, h: np.ndarray, scratch: Scratch | None = None) -> tuple[float, np.ndarray, np.ndarray, int]:
    """Loss, gradient, state behind the window and number of tokens of the steps from low to high.

    The gradient lies in ``scratch`` if given.
    """
    scratch = scratch or Scratch()
    k = int(lanes.active[low])
    source, target = lanes.source[low:high, :k], lanes.target[low:high, :k]
    read = _read(net, source, h[:, :k], scratch, True)
    target = target.ravel()
    order, n, classes = _by_class(net, target)
    real = order[:n]
    tokens = target[real]
    flat = _with_one(read.states.reshape(-1, HIDDEN).take(real, axis=0))
    kind, word = tokens // net.side, tokens % net.side
    grad = Net(net.side, scratch.get("gradient", len(net.flat)))
    grad.flat.fill(0)
    share = np.float32(1 / len(tokens))
    c, o, calm = _outputs(net)
    back = np.empty((len(tokens), HIDDEN), np.float32)
    loss = 0.0
    for at in _blocks(0, len(tokens)):
        log, p, total = _softmax(c, flat[at], kind[at], calm)
        loss -= float(log.sum())
        p *= share / total
        p[kind[at], np.arange(len(log))] -= share
        part = p @ flat[at]
        grad.c += part[:, :HIDDEN].T
        grad.cb += part[:, HIDDEN]
        np.matmul(p.T, net.c.T, out=back[at])
    for ks, at, valid in _groups(classes):
        own = (np.arange(len(ks))[:, None], word[at], np.arange(at.shape[1]))
        states, weights = flat.take(at, axis=0), o[ks].transpose(0, 2, 1)
        q = weights @ states.transpose(0, 2, 1)
        if not calm:
            q -= q.max(1, keepdims=True)
        log = q[own]
        np.exp(q, q)
        total = q.sum(1)
        log -= np.log(total)
        loss -= float(log[valid].sum())
        shares = share * valid
        q *= (shares / total)[:, None]
        q[own] -= shares
        part = states.transpose(0, 2, 1) @ q.transpose(0, 2, 1)
        grad.o[ks], grad.ob[ks] = part[:, :HIDDEN], part[:, HIDDEN]
        back[at[valid]] += (q.transpose(0, 2, 1) @ weights[:, :, :HIDDEN])[valid]
    outer = scratch.get("outer", source.size, HIDDEN)
    outer.fill(0)
    outer[real] = back
    unwind(net, grad, source, h[:, :k], read, outer.reshape(*source.shape, HIDDEN), scratch)
    return loss, grad.flat, read.states[-1].T.copy(), len(tokens)


class Adam:
    """The sums of gradients and of their squares are ten and a hundred times the usual means, which saves passes over them."""

    def __init__(self, net: Net, rate: float):
        self.net, self.rate, self.step = net, rate, 0
        self.first, self.second, self.change = np.zeros_like(net.flat), np.zeros_like(net.flat), np.empty_like(net.flat)

    def update(self, grad: np.ndarray, share: float) -> None:
        """A step of the rate times ``share``, the part of a full window that the gradient comes from."""
        norm = float(np.sqrt(grad @ grad))
        if norm > 1:
            grad = grad / norm
        self.step += 1
        change = self.change
        self.first *= 0.9
        self.first += grad
        self.second *= 0.99
        np.multiply(grad, grad, change)
        self.second += change
        # 0.1 first / (sqrt(0.01 second) unbias + 1e-6), the fraction divided by 0.1 unbias
        unbias = 1 / np.sqrt(1 - 0.99**self.step)
        np.sqrt(self.second, change)
        change += 1e-5 / unbias
        np.divide(self.first, change, change)
        change *= self.rate * share / unbias / (1 - 0.9**self.step)
        self.net.flat -= change


def train_on(net: Net, adam: Adam, ids: np.ndarray, bounds: np.ndarray) -> tuple[float, int]:
    """One pass over the documents; small batches get fewer lanes, so that there are enough updates.

    Where only a few long documents are left the steps are smaller, so that every token weighs the same.
    """
    lanes = lay_out(ids, bounds, int(np.clip(len(ids) // (STEPS * 100), 4, 384)), net.start)
    full = STEPS * lanes.target.shape[1]
    h = np.zeros((HIDDEN, lanes.target.shape[1]), np.float32)
    loss, count, scratch = 0.0, 0, Scratch()
    for low in range(0, len(lanes.target), STEPS):
        part, grad, h, n = gradient(net, lanes, low, min(low + STEPS, len(lanes.target)), h, scratch)
        adam.update(grad, n / full)
        loss, count = loss + part, count + n
    return loss, count


def score_on(net: Net, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each document; states of several windows meet the outputs together."""
    lanes = lay_out(ids, bounds, 512, net.start)
    h = np.zeros((HIDDEN, lanes.target.shape[1]), np.float32)
    total, scratch = np.zeros(len(bounds) - 1), Scratch()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0
    for low in range(0, len(lanes.target), STEPS):
        k = int(lanes.active[low])
        part = slice(low, low + STEPS)
        states = recur(net, lanes.source[part, :k], h[:, :k], scratch)
        h = states[:, -1].copy()
        tokens = lanes.target[part, :k].ravel()
        real = np.flatnonzero(tokens >= 0)
        held.append((states.transpose(1, 2, 0).reshape(-1, HIDDEN).take(real, axis=0), tokens[real], lanes.owner[part, :k].ravel()[real]))
        waiting += len(real)
        if waiting >= TOGETHER or low + STEPS >= len(lanes.target):
            states, tokens, owner = (np.concatenate(x) for x in zip(*held, strict=True))
            total += np.bincount(owner, log_likelihood(net, states.T, tokens).astype(np.float64), len(total))
            held, waiting = [], 0
    return total


# ---- tokens and counts ------------------------------------------------------------------


class Vocabulary(NamedTuple):
    """Counts of the most frequent tokens, sorted by token, and the network's word of each (or the mark of all others)."""

    tokens: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    side: int
    begins: np.ndarray  # of each prefix of PREFIX bits, where its tokens begin

    def words_of(self, tokens: np.ndarray) -> np.ndarray:
        """The network's word of each token."""
        if not len(self.tokens):
            return np.full(len(tokens), self.side * self.side, np.int32)
        at, known = self.look_up(tokens)
        return np.where(known, self.words[at], self.side * self.side)

    def look_up(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each token here, and whether it is here.

        Tokens are hashes, so their leading bits name a place at or little before their own.
        """
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        last = len(self.tokens) - 1
        at = np.minimum(self.begins[tokens >> np.uint64(64 - PREFIX)], last)
        behind = np.flatnonzero(self.tokens[at] < tokens)
        while len(behind):
            behind = behind[at[behind] < last]
            at[behind] += 1
            behind = behind[self.tokens[at[behind]] < tokens[behind]]
        return at, self.tokens[at] == tokens


def tokenise(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, and where each text's tokens begin."""
    found = find_words(column, lower=True)
    n = len(found.bounds) - 1
    tokens = np.insert(found.hashes, found.bounds[1:], END)
    return tokens, found.bounds + np.arange(n + 1)


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches, "text", CHUNK_BYTES):
        tokens, n = np.unique(tokenise(chunk.column("text"))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], names=["token", "n"])


def count_tokens(texts: DataFrame) -> DataFrame:
    """``token, n`` over all texts; counts are summed in each task before the shuffle."""
    return texts.select("text").mapInArrow(_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, side: int = SIDE, most: int = HEAD) -> tuple[Vocabulary, int]:
    """The tokens of count at or above the least threshold that leaves no more than ``most``, and that threshold.

    The threshold comes from a histogram of counts in steps of a sixteenth of an octave.
    """
    step = F.floor(F.log2(F.col("n")) * 16)
    sizes = sorted(((r["s"], r["k"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    held, lowest = 0, None
    for s, k in sizes:
        if held + k > most:
            break
        held, lowest = held + k, s
    found = counts.filter(step >= (lowest if lowest is not None else 1 << 20)).toPandas() if sizes else pd.DataFrame({"token": [], "n": []})
    tokens, n = found["token"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    words = np.full(len(tokens), side * side, np.int32)
    # The end always is a word of the network; the others follow by count.
    frequent = np.lexsort((tokens, -n, tokens != END))[: side * side]
    words[frequent] = np.arange(len(frequent))
    order = np.argsort(tokens)
    sizes = np.bincount((tokens >> np.uint64(64 - PREFIX)).astype(np.int64), minlength=1 << PREFIX)
    begins = (np.cumsum(sizes) - sizes).astype(np.int32)
    return Vocabulary(tokens[order], n[order], words[order], side, begins), int(lowest) if lowest is not None else 1 << 20


# ---- distributed training ---------------------------------------------------------------


def unigram_net(vocabulary: Vocabulary, n_other: int) -> Net:
    """A network whose outputs are the shares of the training counts, whatever its state."""
    side = vocabulary.side
    net = Net(side)
    n = np.full(side * side, SMOOTHING)
    spelled = vocabulary.words < side * side
    n[vocabulary.words[spelled]] += vocabulary.counts[spelled]
    classes = n.reshape(side, side).sum(1)
    net.c *= 0.1
    net.o *= 0.1
    net.cb[:] = np.log(np.append(classes, n_other + SMOOTHING) / (classes.sum() + n_other + SMOOTHING))
    net.ob[:] = np.log(n.reshape(side, side) / classes[:, None])
    return net


def _trainer(flat: np.ndarray, vocabulary: Vocabulary, rate: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        net = Net(vocabulary.side, flat.copy())
        adam, loss, count = Adam(net, rate), 0.0, 0
        for chunk in gathered(batches, "text", CHUNK_BYTES):
            tokens, bounds = tokenise(chunk.column("text"))
            part, n = train_on(net, adam, vocabulary.words_of(tokens), bounds)
            loss, count = loss + part, count + n
        if count:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([count], pa.int64()), pa.array([loss]), pa.array([net.flat.tobytes()], pa.binary())],
                names=["task", "n", "loss", "net"],
            )

    return run


def _average(group: pd.DataFrame) -> pd.DataFrame:
    n = group["n"].to_numpy(np.float64)
    nets = np.stack([np.frombuffer(b, np.float32) for b in group["net"]]).astype(np.float64)
    mean = (nets * n[:, None]).sum(0) / n.sum()
    return pd.DataFrame({"task": [group["task"].iloc[0] // MERGED], "n": [int(n.sum())], "loss": [group["loss"].sum()], "net": [mean.astype(np.float32).tobytes()]})


def train(texts: DataFrame, vocabulary: Vocabulary, n_other: int, rounds=ROUNDS) -> tuple[Net, list[float]]:
    """The trained network and the mean loss of each round; ``texts`` has ``row, text``.

    ``n_other`` tokens of the texts are no words of the network. Training begins with unigram shares.
    Copies are averaged ``MERGED`` at a time, level by level, so no task holds more than that many and
    the driver gets one.
    """
    schema = "task long, n long, loss double, net binary"
    net, low, losses = unigram_net(vocabulary, n_other), 0.0, []
    share = F.pmod(F.xxhash64("row", F.lit("round")), F.lit(1 << 20)) / float(1 << 20)
    for high, rate in rounds:
        part = texts.filter((share >= low) & (share < high)).select("text")
        copies = written(part.mapInArrow(_trainer(net.flat, vocabulary, rate), schema), "copies")
        while copies.count() > 1:
            copies = written(copies.groupBy(F.floor(F.col("task") / MERGED).alias("g")).applyInPandas(_average, schema), "copies")
        low = high
        found = copies.toPandas()
        if len(found):
            net = Net(vocabulary.side, np.frombuffer(found["net"][0], np.float32).copy())
            losses.append(found["loss"][0] / found["n"][0])
    return net, losses


# ---- scores -----------------------------------------------------------------------------


def _scorer(flat: np.ndarray, vocabulary: Vocabulary):
    logs = np.log10(vocabulary.counts + SMOOTHING)
    names = ["doc_id", "row", "held_out", "n_tokens", "n_head", "head_log", "n_other", "other_log", "tail", "times", "net_log"]

    def counted(chunk: pa.RecordBatch) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
        """All columns but the network's score, the network's words of the tokens, and each document's number of them."""
        tokens, bounds = tokenise(chunk.column("text"))
        at, known = vocabulary.look_up(tokens)
        every = vocabulary.side * vocabulary.side
        ids = np.where(known, vocabulary.words[at], every) if len(vocabulary.tokens) else np.full(len(tokens), every)
        n = len(bounds) - 1
        owner = np.repeat(np.arange(n), np.diff(bounds))
        log = np.where(known, logs[at], 0) if len(vocabulary.tokens) else np.zeros(len(tokens))
        other = ids == every
        tail = np.flatnonzero(~known)
        order = tail[np.lexsort((tokens[tail], owner[tail]))]
        new = np.ones(len(order), bool)
        new[1:] = (tokens[order][1:] != tokens[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        first = np.flatnonzero(new)
        cut = np.searchsorted(owner[order[first]], np.arange(n + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(cut, pa.array(v)) for v in (tokens[order[first]].view(np.int64), np.diff(np.append(first, len(order))))]
        sums = [np.bincount(owner, w, n) for w in (known, log, other, log * other)]
        columns = [
            *(chunk.column(c) for c in ("doc_id", "row", "held_out")),
            pa.array(np.diff(bounds)),
            pa.array(sums[0].astype(np.int64)),
            pa.array(sums[1]),
            pa.array(sums[2].astype(np.int64)),
            pa.array(sums[3]),
            *lists,
        ]
        return columns, ids.astype(np.int32), np.diff(bounds)

    def scored(net: Net, parts: list[tuple[list[pa.Array], np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """The parts with the network's scores; their documents are read side by side."""
        ids, lengths = (np.concatenate([part[i] for part in parts]) for i in (1, 2))
        found = score_on(net, ids, np.concatenate([[0], np.cumsum(lengths)])) / np.log(10)
        low = 0
        for columns, _, own in parts:
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found[low : low + len(own)])], names=names)
            low += len(own)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, parts = Net(vocabulary.side, flat.copy()), []
        for chunk in gathered(batches, "text", CHUNK_BYTES):
            parts.append(counted(chunk))
            if sum(len(ids) for _, ids, _ in parts) >= SCORED:
                yield from scored(net, parts)
                parts = []
        if parts:
            yield from scored(net, parts)

    return run


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: a tenth by checksum of the id (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = HEAD) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, row``.

    ``base_score`` sums log10((c + 0.1) / (N + 0.1 (V + 1))) over the document's tokens, with counts c
    of the rows not held out; ``score`` is the network's log10 probability of the tokens. Null text
    counts as empty: its one token is the end. Nothing to learn from leaves N and V at 0.
    Tokens are told apart by 64-bit hashes. Repeated rows are documents of their own; other columns are
    not read.
    """
    kind = dict(docs.dtypes)[id_col]
    docs = numbered(docs)
    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(ROW).alias("row"),
        held_out(id_col).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    learned = texts.filter(~F.col("held_out"))
    counts = written(count_tokens(learned), "token-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = int(total[0]), int(total[1])
    vocabulary, lowest = head_of(counts, side_for(v), most)
    spelled = vocabulary.words < vocabulary.side**2
    n_other, v_other = n - int(vocabulary.counts[spelled].sum()), v - int(spelled.sum())
    net, _ = train(learned.select("row", "text"), vocabulary, n_other)
    scored = written(
        texts.mapInArrow(
            _scorer(net.flat, vocabulary),
            f"doc_id {kind}, row long, held_out boolean, n_tokens long, n_head long, head_log double, n_other long, "
            "other_log double, tail array<long>, times array<long>, net_log double",
        ),
        "scored",
    )
    rare = counts.filter(F.floor(F.log2(F.col("n")) * 16) < lowest)
    tail = (
        scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t"))
        .select("row", F.col("t.tail").alias("token"), F.col("t.times").alias("times"))
        .join(rare, "token", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_tail"),
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTHING)).alias("tail_log"),
        )
    )
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    base = float(np.log10(n + SMOOTHING * (v + 1)))
    other = float(np.log10(n_other + SMOOTHING * (v_other + 1)))
    return scored.drop("tail", "times").join(tail, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail_log - F.col("n_tokens") * base).alias("base_score"),
        (F.col("net_log") + F.col("other_log") + tail_log - F.col("n_other") * other).alias("score"),
        "row",
    )
