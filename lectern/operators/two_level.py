"""Clustered search whose number of lists grows with the table: a quantiser of quantisers.

Roots are cluster centres of all vectors, about as many as the square root of the number of lists. Each
root's vectors are cut into lists by centres of their own, trained on a sample in proportion to the lists. A query
looks at all roots and at the centres below the best of them, so probing costs about the square root of the
number of lists. Centres below roots stay in a table; only roots are held by the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions.rows import each
from lectern.operators import retrieval as R
from lectern.operators.ordinals import top_rows
from lectern.session import scratch_path
from lectern.sources.store import stored

LIST_ITEMS = 1_000
# Bounds of a root's training: so many lists, and sampled vectors for each. They bound the fit, never the items.
MOST_ROOTS, MOST_LISTS, LIST_SAMPLE = 1_024, 1_024, 64
# Probed lists that are named in a filter on the stored items.
NAMED_LISTS = 10_000
# Lists whose centres are sent to every task that looks for probed lists by itself, and scores of centres that are held at once there.
SENT_LISTS, PROBED_SCORES = 1 << 16, 1 << 20


@dataclass(frozen=True)
class TwoLevelIndex:
    """Items with their ``list_id``, the centres of lists (``item_id`` the list, ``list_id`` its root), and the roots."""

    items: DataFrame
    lists: DataFrame
    roots: np.ndarray

    def centres(self) -> R.ClusterIndex:
        return R.ClusterIndex(self.lists, self.roots)


def centres(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """At most ``k`` unit centres by inner product; a centre without vectors stays where it was."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), fixed.NORM_EPS)
    found = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        best = np.concatenate([(x[i : i + 4096] @ found.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(found)
        np.add.at(sums, best, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norms > fixed.NORM_EPS, sums / np.maximum(norms, fixed.NORM_EPS), found)
    return found


def two_level_build(items: DataFrame, list_items: int = LIST_ITEMS, seed: int = 7) -> TwoLevelIndex:
    """Lists of about ``list_items`` items each (more below a root that would need over ``MOST_LISTS``).

    A table that fits one list has no root: its items lie in the list -1, which every query reads.
    """
    pool = items.filter(F.col("embedding").isNotNull())
    spark, n = items.sparkSession, pool.count()
    if n <= list_items:
        return TwoLevelIndex(pool.withColumn("list_id", F.lit(-1)), spark.createDataFrame([], "item_id int, embedding array<double>, list_id int"), np.zeros((0, 1)))
    roots = min(MOST_ROOTS, max(2, round(np.sqrt(n / list_items))))
    rooted = R.ivf_build(pool, nlist=roots, seed=seed)
    held = {r["list_id"]: r["count"] for r in rooted.items.groupBy("list_id").count().collect()}  # one row per root
    wanted = {root: min(MOST_LISTS, -(-size // list_items)) for root, size in sorted(held.items())}
    offset = dict(zip(wanted, np.cumsum([0, *wanted.values()])[:-1].tolist(), strict=True))
    rows = [(root, wanted[root], min(1.0, LIST_SAMPLE * wanted[root] / held[root])) for root in wanted]
    shares = F.broadcast(spark.createDataFrame(rows, "list_id int, wanted int, share double"))
    drawn = F.pmod(F.xxhash64("item_id", F.lit(seed)), F.lit(1 << 30)) < F.col("share") * F.lit(1 << 30)

    def train(sample: pd.DataFrame) -> pd.DataFrame:
        root = int(sample["list_id"].iloc[0])
        found = centres(np.stack(sample["embedding"].to_numpy()).astype(np.float64), int(sample["wanted"].iloc[0]), seed)
        return pd.DataFrame({"item_id": offset[root] + np.arange(len(found)), "embedding": list(found), "list_id": root})

    sample = rooted.items.select("item_id", "embedding", "list_id").join(shares, "list_id").filter(drawn).select("list_id", "wanted", "embedding")
    lists = stored(sample.groupBy("list_id").applyInPandas(train, "item_id int, embedding array<double>, list_id int"), scratch_path(spark, "centres"))
    nearest = R.ivf_search(R.ClusterIndex(lists, rooted.centroids), pool.select(F.col("item_id").alias("query_id"), "embedding"), 1, 1)
    assigned = pool.join(nearest.select(F.col("query_id").alias("item_id"), F.col("item_id").alias("list_id")), "item_id", "left")
    # A root so small that its sample was empty has no list; its items lie in the list -1.
    return TwoLevelIndex(assigned.withColumn("list_id", F.coalesce("list_id", F.lit(-1))), lists, rooted.centroids)


def two_level_store(index: TwoLevelIndex, path: str) -> TwoLevelIndex:
    """Writes the index. Items lie in range partitions by list and id: as many files as partitions, and a list of any size is cut."""
    spark = index.items.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index.items.repartitionByRange(parts, "list_id", "item_id").sortWithinPartitions("list_id").write.parquet(f"{path}/items")
    index.lists.repartitionByRange(max(1, parts // 4), "list_id").write.parquet(f"{path}/lists")
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(index.roots)]
    # No roots are an empty table of the same columns.
    spark.createDataFrame(rows, "root int, centre array<double>").coalesce(1).write.parquet(f"{path}/roots")
    return two_level_load(spark, path)


def two_level_load(spark, path: str) -> TwoLevelIndex:
    rows = spark.read.parquet(f"{path}/roots").orderBy("root").collect()  # at most MOST_ROOTS
    return TwoLevelIndex(spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/lists"), np.array([r["centre"] for r in rows]).reshape(len(rows), -1) if rows else np.zeros((0, 1)))


@dataclass(frozen=True)
class ProbedKernel:
    """Inner products of the items of each list with the queries whose ``lists`` name it."""

    skip_same_id: bool = False

    def prepare(self, queries: pa.Table) -> tuple:
        query_ids, q = R._ids(queries["query_id"]), R._matrix(queries["embedding"])
        lists = R._plain(queries["lists"])
        asking = np.repeat(np.arange(len(query_ids)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        named = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(named, kind="stable")
        return query_ids, q, asking[order], named[order]

    def __call__(self, items: pa.Table, prepared: tuple, k: int) -> Iterator[tuple]:
        query_ids, q, asking, named = prepared
        item_ids, x, order = R._sorted_items(items)
        lists = R._ids(items["list_id"]).astype(np.int64)[order]
        by_list = np.argsort(lists, kind="stable")
        exact = R.VectorKernel("ip", self.skip_same_id)
        edges = np.append(np.flatnonzero(np.diff(lists[by_list], prepend=-2)), len(lists))
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            own = by_list[a:z]
            low, high = np.searchsorted(named, lists[own[0]], "left"), np.searchsorted(named, lists[own[0]], "right")
            if high > low:
                yield from exact.scored(item_ids[own], x[own], query_ids[asking[low:high]], q[asking[low:high]], k)


def _least(costs: np.ndarray, n: int) -> np.ndarray:
    """Whether each place holds one of the ``n`` least finite costs of its row; equal costs go to the lower column."""
    if n >= costs.shape[1]:
        return np.isfinite(costs)
    cut = np.partition(costs, n - 1, axis=1)[:, n - 1 : n]
    found, same = costs < cut, (costs == cut) & np.isfinite(cut)
    spare = n - found.sum(axis=1)
    for row in np.flatnonzero(same.sum(axis=1) > spare):
        same[row, np.flatnonzero(same[row])[spare[row] :]] = False
    return found | same


@dataclass(frozen=True)
class WideKernel:
    """Inner products of items and queries that probe many lists: which, is found in the task from the centres.

    Queries then travel without their lists, once per fragment of items and not once per list.
    """

    roots: np.ndarray
    centres: np.ndarray
    root_of: np.ndarray
    list_ids: np.ndarray  # in order
    nprobe: int
    best_roots: int
    skip_same_id: bool = False

    def prepare(self, queries: pa.Table) -> tuple:
        return R._ids(queries["query_id"]), R._matrix(queries["embedding"])

    def probed(self, q: np.ndarray) -> np.ndarray:
        """Whether each query probes each list; behind the lists comes the list -1, which all probe."""
        found = np.zeros((len(q), len(self.list_ids) + 1), bool)
        found[:, -1] = True
        step = max(1, PROBED_SCORES // max(1, len(self.list_ids)))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            costs = np.round(part @ -self.centres.T, R.SCORE_DECIMALS)
            if self.best_roots < len(self.roots):
                below = np.zeros((len(part), len(self.roots)), bool)
                np.put_along_axis(below, R._best_lists(part, self.roots, self.best_roots), True, axis=1)
                costs[~below[:, self.root_of]] = np.inf
            found[at : at + step, :-1] = _least(costs, self.nprobe)
        return found

    def __call__(self, items: pa.Table, prepared: tuple, k: int) -> Iterator[tuple]:
        query_ids, q = prepared
        item_ids, x, order = R._sorted_items(items)
        lists = R._ids(items["list_id"]).astype(np.int64)[order]
        lists = np.where(lists < 0, len(self.list_ids), np.searchsorted(self.list_ids, lists))
        own = R._own_places(item_ids, query_ids) if self.skip_same_id else None

        def allowed_of(queries: slice) -> tuple[Callable, Callable]:
            probed = self.probed(q[queries])
            return lambda part: probed[:, lists[part]], lambda row, col: probed[row, lists[col]]

        for rows, cols, found in R._best_of_blocks(q, x, k, "ip", own, allowed_of):
            yield query_ids[rows], item_ids[cols], found


def _wide(index: TwoLevelIndex, nprobe: int, roots: int, skip_same_id: bool) -> WideKernel:
    """The kernel with all centres: at most ``SENT_LISTS`` of them."""
    lists = index.lists.select("item_id", "embedding", "list_id").toArrow().sort_by("item_id")
    return WideKernel(
        index.roots,
        R._matrix(lists["embedding"]),
        R._ids(lists["list_id"]).astype(np.int64),
        R._ids(lists["item_id"]).astype(np.int64),
        nprobe,
        min(roots, len(index.roots)),
        skip_same_id,
    )


def probes(index: TwoLevelIndex, queries: DataFrame, nprobe: int, roots: int) -> DataFrame:
    """``query_id, lists``: the best ``nprobe`` lists of each query below its best ``roots`` roots, and the list -1."""
    if not len(index.roots):
        return queries.select("query_id", F.array(F.lit(-1)).alias("lists")).distinct()
    found = R.ivf_search(index.centres(), queries, nprobe, roots)
    best = found.groupBy("query_id").agg(F.collect_list(F.col("item_id").cast("int")).alias("lists"))
    return best.withColumn("lists", F.concat("lists", F.array(F.lit(-1))))


def two_level_search(
    index: TwoLevelIndex,
    queries: DataFrame,
    k: int = fixed.RETRIEVAL_K,
    nprobe: int = 8,
    roots: int = 4,
    skip_same_id: bool = False,
    broadcast_rows: int = R.BROADCAST_ROWS,
) -> DataFrame:
    """Top-k among the items of the lists that each query probes.

    Counted queries are sent to every task with their lists, and items are scored where they lie; more queries meet
    the items in cells of (list, fragment), as in clustered search. Many queries that probe more lists than there are
    fragments of items and queries meet all items in cells of (fragment, fragment), where their lists are found again.
    """
    encoded = queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding")
    pool = index.items.select("item_id", "embedding", "list_id")
    many = encoded.limit(broadcast_rows + 1).count() > broadcast_rows
    if many and len(index.roots) and index.lists.count() <= SENT_LISTS:
        cell_items, cell_queries = R.vector_cells(pool, encoded)
        if min(nprobe, index.lists.count()) > pool.count() // cell_items + encoded.count() // cell_queries:
            found = R.search_cells(pool, encoded, _wide(index, nprobe, roots, skip_same_id), k, None, cell_items, cell_queries)
            return top_rows(found, ["query_id"], [F.col("score").desc(), F.col("item_id")], k)
    asked = encoded.join(probes(index, encoded, nprobe, roots), "query_id")
    small = R._counted(asked, broadcast_rows)
    if small is not None:
        named = np.unique(R._plain(small["lists"]).flatten().to_numpy(zero_copy_only=False)) if small.num_rows else []
        if len(named) <= NAMED_LISTS:
            pool = pool.filter(F.col("list_id").isin([int(i) for i in named]))
        found = R._search_in_place(pool, asked, small, ProbedKernel(skip_same_id), k)
    else:
        exploded = each(asked, ["query_id", "embedding"], F.col("lists"), "list_id")
        found = R.search_cells(pool, exploded, R.VectorKernel("ip", skip_same_id), k, ["list_id"])
    return top_rows(found, ["query_id"], [F.col("score").desc(), F.col("item_id")], k)


def scored_share(index: TwoLevelIndex, queries: DataFrame, nprobe: int = 8, roots: int = 4) -> float:
    """Share of (item, query) pairs that a search scores."""
    sizes = index.items.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    read = each(probes(index, queries, nprobe, roots), ["query_id"], F.col("lists"), "list_id").join(sizes, "list_id")
    met, n, asked = read.agg(F.sum("n")).first()[0] or 0, index.items.count(), queries.count()
    return met / max(1, n * asked)
