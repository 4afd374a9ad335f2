"""Language identification by a convolutional network over bytes.

Texts are cut into windows of a fixed number of bytes that cover the whole text. Every window goes
through filters of several widths over byte embeddings, a maximum over positions, and a softmax; a
text's language is the one with the highest mean probability, windows weighted by their bytes.
The network is trained in numpy on the windows of a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import numbered, row_number, text_or_empty, without_rows, written
from lectern.llm.words import chunks, mix, text_bytes

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
UNKNOWN = "und"
# Mean probability of the predicted language below which a text counts as not identified: all others together are likelier.
LEAST_SCORE = 0.5
# Windows of labelled text that the network is fitted on, shared out among the languages, at most;
# each language has one at least, however many there are.
TRAIN_WINDOWS = 12_000
# Windows that tasks emit of a language beyond twice its share, so that chance leaves none short.
SPARE = 64
BATCH = 512


def windows(
    column: pa.Array, width: int = WINDOW, pick: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte windows (zero-padded), the text each belongs to, and their numbers of bytes.

    An empty text has no window. Every byte of a text is in exactly one window. ``pick`` chooses
    windows by text and size; all are returned without it.
    """
    data, offsets = text_bytes(column)
    lengths = np.diff(offsets)
    per_text = -(-lengths // width)
    owner = np.repeat(np.arange(len(lengths)), per_text)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = offsets[:-1][owner] + nth * width
    size = np.minimum(width, offsets[1:][owner] - begin)
    if pick:
        chosen = np.flatnonzero(pick(owner, size))
        owner, begin, size = owner[chosen], begin[chosen], size[chosen]
    at = begin[:, None] + np.arange(width)
    inside = np.arange(width) < size[:, None]
    out = np.where(inside, data[np.minimum(at, max(0, len(data) - 1))] if len(data) else 0, 0).astype(np.uint8)
    return out, owner, size


class ByteNet:
    """Parameters and passes of the network; plain arrays, so it travels with the task."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embedding = rng.normal(0, 0.3, (256, EMBEDDING)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.bias, self.out, self.out_bias]

    def features(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of every filter, and where it was."""
        found, places = [], []
        for filters, bias in zip(self.filters, self.bias, strict=True):
            width = len(filters)
            positions = x.shape[1] - width + 1
            total = np.zeros((len(x), positions, FILTERS), np.float32)
            for j in range(width):
                # An embedding times a filter's tap is a table with one row per byte.
                total += np.take(self.embedding @ filters[j], x[:, j : j + positions], axis=0)
            place = total.argmax(1)
            found.append(np.take_along_axis(total, place[:, None, :], 1)[:, 0] + bias)
            places.append(place)
        return np.maximum(np.concatenate(found, 1), 0), places

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax per window, in blocks of a bounded number of windows."""
        tables = [np.ascontiguousarray(self.embedding @ f) for f in self.filters]
        parts = []
        for i in range(0, len(x), BATCH):
            block = x[i : i + BATCH]
            found = []
            for table, bias in zip(tables, self.bias, strict=True):
                positions = block.shape[1] - len(table) + 1
                total = table[0].take(block[:, :positions], axis=0)
                for j in range(1, len(table)):
                    total += table[j].take(block[:, j : j + positions], axis=0)
                found.append(total.max(1) + bias)
            logits = np.maximum(np.concatenate(found, 1), 0) @ self.out + self.out_bias
            logits -= logits.max(1, keepdims=True)
            e = np.exp(logits)
            parts.append(e / e.sum(1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        features, places = self.features(x)
        logits = features @ self.out + self.out_bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ self.out.T) * (features > 0)
        embedding = np.zeros_like(self.embedding)
        filters, biases = [], []
        rows = np.arange(len(x))[:, None]
        for i, (w, place) in enumerate(zip(WIDTHS, places, strict=True)):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            biases.append(part.sum(0))
            grads = np.zeros_like(self.filters[i])
            for j in range(w):
                seen = x[rows, place + j]
                taken = self.embedding[seen]
                grads[j] = np.einsum("nfe,nf->ef", taken, part)
                np.add.at(embedding, seen, part[:, :, None] * self.filters[i][j].T[None])
            filters.append(grads)
        return [embedding, *filters, *biases, features.T @ p, p.sum(0)]


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], passes: int = 6, rate: float = 0.01) -> ByteNet:
    """Trains by Adam on windows ``x`` with language numbers ``y``; the same input gives the same network."""
    net = ByteNet(languages)
    rng = np.random.default_rng(11)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    step = 0
    for _ in range(passes):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 64):
            at = order[i : i + 64]
            step += 1
            for p, g, m, v in zip(net.parameters(), net.gradients(x[at], y[at]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _draws(seed: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return mix(seed[owner] + np.arange(len(owner), dtype=np.uint64))


def _quotas(counts: dict[str, int], most: int) -> dict[str, int]:
    """Windows to learn from per language: an equal share, or all where there are fewer; what those leave goes to the others."""
    quotas, left = {}, most
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda c: (c[1], c[0]))):
        quotas[lang] = min(n, max(1, left // (len(counts) - i)))
        left -= quotas[lang]
    return quotas


def _labelled(shares: dict[str, float]):
    """Windows of labelled texts with a hash that orders them at random, of each language that share of all."""
    limits = {lang: np.uint64(min(1.0, share) * (2**64 - 2**12)) for lang, share in shares.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            seed = chunk.column("seed").to_numpy().view(np.uint64)
            limit = np.array([limits[lang] for lang in chunk.column("lang").to_pylist()], np.uint64)
            drawn = []

            def pick(owner, size, seed=seed, limit=limit, drawn=drawn):
                draw = _draws(seed, owner)
                wanted = draw <= limit[owner]
                drawn.append(draw[wanted])
                return wanted

            x, owner, _ = windows(chunk.column("text"), pick=pick)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((drawn[0] >> np.uint64(1)).view(np.int64)),
                    chunk.column("lang").take(pa.array(owner)),
                    pa.array([w.tobytes() for w in x], pa.binary()),
                ],
                names=["draw", "lang", "bytes"],
            )

    return run


def train(labelled: DataFrame, most: int = TRAIN_WINDOWS, id_col: str = "doc_id") -> ByteNet | None:
    """A network fitted on at most ``most`` windows of the rows' whole texts, drawn by hash per language.

    Input columns: the id, ``text`` and ``lang``; null or empty labels and texts are left out.
    Windows of any size and place in a text take part, so short texts teach as well. Windows are counted
    per language first, so that tasks emit about twice ``most`` together. None if there is no window.
    """
    rows = labelled.filter((F.coalesce("lang", F.lit("")) != "") & (F.length("text") > 0)).select(
        "text", "lang", F.xxhash64(id_col, "text").alias("seed")
    )
    found = rows.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / WINDOW)).alias("n")).collect()
    counts = {r["lang"]: int(r["n"]) for r in found}
    if not counts:
        return None
    quotas = _quotas(counts, most)
    shares = {lang: (2 * quotas[lang] + SPARE) / n for lang, n in counts.items()}
    drawn = rows.mapInArrow(_labelled(shares), "draw long, lang string, bytes binary").toPandas().sort_values(["draw", "bytes"])
    picked = drawn[drawn.groupby("lang").cumcount() < drawn["lang"].map(quotas)]
    languages = sorted(picked["lang"].unique())
    x = np.frombuffer(b"".join(picked["bytes"]), np.uint8).reshape(-1, WINDOW)
    return fit(x, np.searchsorted(languages, picked["lang"].to_numpy()), languages)


def _predict(net: ByteNet | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", 1 << 20):
            lettered = chunk.column("lettered").to_numpy(zero_copy_only=False)
            names = np.full(len(lettered), UNKNOWN, object)
            score = np.zeros(len(lettered))
            if net:
                x, owner, size = windows(chunk.column("text"))
                p = net.probabilities(x) * size[:, None]
                total = np.stack([np.bincount(owner, p[:, k], len(lettered)) for k in range(len(net.languages))], 1)
                total /= np.maximum(1, np.bincount(owner, size, len(lettered)))[:, None]
                best = total.argmax(1)
                names[lettered] = np.array(net.languages, object)[best[lettered]]
                score[lettered] = np.clip(total[np.arange(len(best)), best], 0, 1)[lettered]
            columns = [c for i, c in enumerate(chunk.columns) if chunk.schema.names[i] not in ("text", "lettered")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names, pa.string()), pa.array(score)],
                names=[n for n in chunk.schema.names if n not in ("text", "lettered")] + ["lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, net: ByteNet | None, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` with ``lang_pred`` and ``score`` for every row; only keys and text are read.

    ``score`` is the mean probability of the predicted language over the whole text. A null text, a
    text without a letter, and any text when nothing could be learned is ``und`` with score 0.
    """
    text = text_or_empty(text_col)
    kinds = dict(docs.dtypes)
    return docs.select(*keys, text.alias("text"), text.rlike(r"\p{L}").alias("lettered")).mapInArrow(
        _predict(net), ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "lang_pred string", "score double"])
    )


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: a quarter by checksum of the id (a null id: of an empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _learned(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, ByteNet | None]:
    """The rows under fixed names, and the network that those not held out give."""
    named = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        held_out(id_col).alias("held_out"),
        row_number(docs).alias("row"),
    )
    return named, train(named.filter(~F.col("held_out")))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out, predicts all: ``doc_id, held_out, lang_pred, score, row``."""
    named, net = _learned(docs, id_col, text_col, lang_col)
    return predict(named, net, ["doc_id", "held_out", "row"]).select("doc_id", "held_out", "lang_pred", "score", "row")


def drop_unidentified(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows whose language is identified, with all their columns.

    Rejected are texts that are null or have no letter, and texts to which the network gives no language with a
    mean probability of at least ``least_score`` (noise, and texts that change between languages).
    Where nothing could be learned there are no scores, and only the former are rejected.
    """
    docs = numbered(docs)
    named, net = _learned(docs, "doc_id", "text", "lang")
    if net:
        bad = predict(named, net, ["row"]).filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least_score))
    else:
        bad = named.filter(~text_or_empty("text").rlike(r"\p{L}"))
    return without_rows(docs, written(bad.select("row"), "language-dropped"))
