"""Approximate search over hyperplane buckets that are probed in the order of their chance to hold a neighbour.

Every item has one bucket: the sides of ``bits`` random hyperplanes that it lies on. A neighbour whose cosine with the query
is c lies on the other side of a hyperplane at distance m from the (unit) query with probability
Phi(-m c / sqrt(1 - c^2)), independently for each hyperplane. The cost of a bucket is the sum of the log odds of its
flipped sides; buckets are probed by rising cost until their chances add up to the target recall. The cosine
is measured on a bounded sample of items and queries, so near neighbours need few probes and far ones many, however many items there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import fixed
from lectern.operators import retrieval as R

BITS = 32
SAMPLE_ITEMS, SAMPLE_QUERIES = 4_096, 256
DRAWS = 2_048
# Share of probed pairs from which whole blocks are multiplied: a pair picked out of a block costs as much as some 16 of a whole one.
DENSE_SHARE, DENSE_SAMPLE = 1 / 16, 256


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), fixed.NORM_EPS)


def codes(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Bucket of each vector."""
    return ((x @ planes.T >= 0) * (1 << np.arange(len(planes), dtype=np.int64))).sum(axis=1)


def costs(q: np.ndarray, planes: np.ndarray, cosine: float, target: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Side of each query at each hyperplane, the cost of flipping it, and the cost up to which to probe.

    Drawn flips tell how costs of neighbours' buckets are spread; the bound is the quantile of the target.
    """
    distance = _unit(q) @ planes.T
    c = min(max(cosine, 0.0), 0.9999)
    chance = np.vectorize(lambda z: erfc(z / sqrt(2)) / 2, otypes=[float])(np.abs(distance) * c / sqrt(1 - c * c))
    chance = np.clip(chance, 1e-12, 0.5)
    weight = np.log((1 - chance) / chance)
    drawn = np.random.default_rng(seed).random((DRAWS, planes.shape[0]))
    bound = np.array([np.quantile((drawn < p) @ w, target, method="higher") for p, w in zip(chance, weight, strict=True)])
    return distance >= 0, weight, bound + 1e-9


@dataclass(frozen=True)
class ProbeKernel:
    """Inner products of queries and the items of the buckets that they probe."""

    planes: np.ndarray
    cosine: float
    target: float
    skip_same_id: bool = False

    def prepare(self, queries: pa.Table) -> tuple:
        query_ids, q = R._ids(queries["query_id"]), R._matrix(queries["embedding"])
        if not len(query_ids):
            return query_ids, q, None, None, None
        sides, weight, bound = costs(q, self.planes, self.cosine, self.target)
        # cost = sum of weights of differing sides = base + bucket bits @ slope
        return query_ids, q, np.where(sides, -weight, weight).T, np.where(sides, weight, 0).sum(axis=1), bound

    def pairs(self, buckets: np.ndarray, prepared: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, query) positions to score, a bounded number of costs at once; each bucket is looked at once."""
        _, _, slope, base, bound = prepared
        named, back = np.unique(buckets, return_inverse=True)
        bits = (named[:, None] >> np.arange(len(self.planes))) & 1
        order = np.argsort(back, kind="stable")
        counts = np.bincount(back, minlength=len(named))
        first = np.cumsum(counts) - counts
        step = max(1, R._BLOCK // max(1, len(bound)))
        for low in range(0, len(named), step):
            bucket, query = np.nonzero(bits[low : low + step].astype(np.float64) @ slope + base <= bound)
            bucket += low
            for at in range(0, len(bucket), R._BLOCK // 16):
                own, asked = bucket[at : at + R._BLOCK // 16], query[at : at + R._BLOCK // 16]
                nth, inside = R._expanded(counts[own])
                yield order[first[own][nth] + inside], asked[nth]

    def dense(self, buckets: np.ndarray, prepared: tuple) -> bool:
        """Whether many of the pairs are probed, by evenly drawn items and queries. It decides how hits are found, not which."""
        _, q, slope, base, bound = prepared
        own = buckets[:: -(-len(buckets) // DENSE_SAMPLE)]
        asked = slice(None, None, -(-len(q) // DENSE_SAMPLE))
        bits = ((own[:, None] >> np.arange(len(self.planes))) & 1).astype(np.float64)
        return float((bits @ slope[:, asked] + base[asked] <= bound[asked]).mean()) >= DENSE_SHARE

    def whole(self, item_ids: np.ndarray, x: np.ndarray, buckets: np.ndarray, prepared: tuple, k: int) -> Iterator[tuple]:
        """Hits from products of whole blocks, in which pairs that are not probed are no hits."""
        query_ids, q, slope, base, bound = prepared
        own = R._own_places(item_ids, query_ids, all_rows=True) if self.skip_same_id else None

        def bits(items: slice | np.ndarray) -> np.ndarray:
            return ((buckets[items, None] >> np.arange(len(self.planes))) & 1).astype(np.float64)

        def allowed_of(queries: slice) -> tuple[Callable, Callable]:
            weights, left = slope[:, queries].T, (bound - base)[queries]

            def listed(row: np.ndarray, col: np.ndarray) -> np.ndarray:
                return np.einsum("nb,nb->n", weights[row], bits(col)) <= left[row]

            return lambda items: weights @ bits(items).T <= left[:, None], listed

        for rows, cols, found in R._best_of_blocks(q, x, k, "ip", own, allowed_of):
            yield query_ids[rows], item_ids[cols], found

    def __call__(self, items: pa.Table, prepared: tuple, k: int) -> Iterator[tuple]:
        query_ids, q = prepared[:2]
        item_ids, x, order = R._sorted_items(items)
        if not len(item_ids) or not len(query_ids):
            return
        buckets = items["bucket"].to_numpy()[order] if "bucket" in items.column_names else codes(x, self.planes)
        if self.dense(buckets, prepared):
            yield from self.whole(item_ids, x, buckets, prepared, k)
            return
        for item, query in self.pairs(buckets, prepared):
            if self.skip_same_id:
                other = item_ids[item] != query_ids[query]
                item, query = item[other], query[other]
            scores = np.concatenate(
                [np.einsum("nd,nd->n", x[item[i : i + R._PAIRS]], q[query[i : i + R._PAIRS]]) for i in range(0, len(item), R._PAIRS)] or [np.zeros(0)]
            )
            query, item, scores = R._best_pairs(query, item, np.round(scores, R.SCORE_DECIMALS) + 0.0, k)
            yield query_ids[query], item_ids[item], scores


@dataclass(frozen=True)
class ProbeIndex:
    """Items with their ``bucket`` and the hyperplanes."""

    items: DataFrame
    planes: np.ndarray
    n: int


def probe_build(items: DataFrame, bits: int = BITS, seed: int = 7) -> ProbeIndex:
    """Assigns each item its bucket; null vectors are left out."""
    if not 0 < bits <= 62:
        raise ValueError("a bucket has 1 to 62 bits")
    pool = items.filter(F.col("embedding").isNotNull())
    held = pool.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    planes = np.random.default_rng(seed).standard_normal((bits, held["dim"] or 1))

    @F.arrow_udf(T.LongType())
    def bucket(embeddings: pa.Array) -> pa.Array:
        return pa.array(codes(R._matrix(embeddings), planes) if len(embeddings) else np.zeros(0, np.int64), pa.int64())

    return ProbeIndex(pool.withColumn("bucket", bucket.asNondeterministic()(F.col("embedding"))), planes, held["n"])


def probe_store(index: ProbeIndex, path: str) -> ProbeIndex:
    """Writes the index with neighbouring buckets side by side; a bucket of any size is cut by item id."""
    spark = index.items.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index.items.repartitionByRange(parts, "bucket", "item_id").sortWithinPartitions("bucket").write.parquet(f"{path}/items")
    rows = [(i, [float(c) for c in p], index.n) for i, p in enumerate(index.planes)]
    spark.createDataFrame(rows, "plane int, normal array<double>, n long").coalesce(1).write.parquet(f"{path}/planes")
    return probe_load(spark, path)


def probe_load(spark, path: str) -> ProbeIndex:
    rows = spark.read.parquet(f"{path}/planes").orderBy("plane").collect()
    return ProbeIndex(spark.read.parquet(f"{path}/items"), np.array([r["normal"] for r in rows]), rows[0]["n"])


def neighbour_cosine(index: ProbeIndex, queries: DataFrame, k: int, skip_same_id: bool = False) -> float:
    """Cosine that all but a quarter of the queries' k-th neighbours exceed, from samples of bounded size.

    ``SAMPLE_ITEMS`` items and ``SAMPLE_QUERIES`` queries are drawn by a hash of their ids. The k-th of n items
    is looked up at the same share of the sample, or at its first place where n is larger: then the cosine is
    understated, and more buckets than needed are probed.
    """

    def drawn(df: DataFrame, key: str, most: int, n: int) -> pa.Table:
        share = F.pmod(F.xxhash64(key, F.lit("probe")), F.lit(1 << 30)) < F.lit(int(min(1.0, 1.5 * most / max(1, n)) * (1 << 30)))
        return df.filter(F.col("embedding").isNotNull() & share).select(key, "embedding").limit(most).toArrow()

    items = drawn(index.items, "item_id", SAMPLE_ITEMS, index.n)
    asked = drawn(queries, "query_id", SAMPLE_QUERIES, queries.count())
    if not items.num_rows or not asked.num_rows:
        return 0.0
    scores = _unit(R._matrix(asked["embedding"])) @ _unit(R._matrix(items["embedding"])).T
    if skip_same_id:
        scores[R._ids(asked["query_id"])[:, None] == R._ids(items["item_id"])[None, :]] = -1.0
    place = min(max(1, -(-k * items.num_rows // max(1, index.n))), items.num_rows)
    return float(np.quantile(-np.partition(-scores, place - 1, axis=1)[:, place - 1], 0.25))


def probe_search(
    index: ProbeIndex,
    queries: DataFrame,
    k: int = fixed.RETRIEVAL_K,
    target: float = 0.9,
    skip_same_id: bool = False,
    strategy: str = "auto",
    broadcast_rows: int = R.BROADCAST_ROWS,
) -> DataFrame:
    """Top-k of the items in probed buckets, scored exactly; ``target`` is the recall that the probes are chosen for.

    Vectors are expected to have unit length. Counted queries are sent to every task and items are scored
    where they lie; more queries meet them in cells of bounded size, as in exact search.
    """
    if not 0 < target < 1:
        raise ValueError("the target recall lies between 0 and 1")
    asked = queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding")
    pool = index.items.select("item_id", "embedding", "bucket")
    # Without items there are no hyperplanes of the queries' dimension either.
    kernel = ProbeKernel(index.planes, neighbour_cosine(index, asked, k, skip_same_id), target, skip_same_id) if index.n else R.VectorKernel()
    return R._top_k(pool, asked, kernel, k, strategy, broadcast_rows)[0]


def probed_share(index: ProbeIndex, queries: DataFrame, k: int = fixed.RETRIEVAL_K, target: float = 0.9) -> float:
    """Share of (item, query) pairs that a search scores, for queries few enough for every task."""
    asked = queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding")
    small = R._counted(asked, R.BROADCAST_ROWS)
    if small is None:
        raise ValueError("too many queries to send to every task")
    kernel = ProbeKernel(index.planes, neighbour_cosine(index, asked, k), target)
    shipped = index.items.sparkSession.sparkContext.broadcast(small)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = kernel.prepare(shipped.value)
        for batch in batches:
            met = sum(len(item) for item, _ in kernel.pairs(batch.column("bucket").to_numpy(), prepared)) if batch.num_rows else 0
            yield pa.RecordBatch.from_arrays([pa.array([met], pa.int64())], names=["met"])

    met = index.items.select("bucket").mapInArrow(count, "met long").agg(F.sum("met")).first()[0] or 0
    return met / max(1, index.n * small.num_rows)
