"""N-gram Jaccard join: a blocked sparse product of documents by n-grams.

The incidence matrix of documents (rows) by word n-grams (columns) is cut into column blocks by
n-gram hash. Two documents that reach the threshold differ in at most ``d`` columns, a bound that
follows from their sizes alone, so among more than ``d`` blocks they agree in at least one: only
pairs with an equal block row are multiplied out, all others lie below the size-derived bound. The
number of blocks follows the size of the documents (sizes are cut into ranges; a document is blocked
once for every range in which a partner may lie). For an active pair the overlap counts of all
columns are accumulated exactly.

Pairs of one group of copies are never all formed: members of a block are paired with its smallest
member, first inside each chunk of the input, then between chunks. What is linked already needs no
further pair. Where members of a block stay in different components, their rows of the matrix are
multiplied out in tiles, all pairs across components at once inside a task, so no link is lost.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import ROW, numbered, shuffle_partitions, sized, without_rows, written
from lectern.llm.components import components
from lectern.llm.words import chunks, find_words, mix, numbers, sequence_hashes

# Documents of a tile, and columns that a task multiplies out at a time.
TILE = 1024
COLUMNS = 2048
# The block of documents with equal sets.
TWINS = 0
EMPTY_BLOCK = np.uint64(0x5851F42D4C957F2D)


class Ranges:
    """Ranges of set sizes, their bound on differing columns, and their numbers of blocks."""

    def __init__(self, percent: int):
        if not 1 <= percent <= 100:
            raise ValueError("percent must be between 1 and 100")
        self.percent = percent
        self.lefts = [1]

    def _reach(self, size: int) -> None:
        while self.lefts[-1] <= size:
            left = self.lefts[-1]
            self.lefts.append(max(left + 1, -(-left * 10_000 // self.percent**2)))

    def of(self, size: int) -> range:
        """Ranges in which a set of this size looks for partners of its size or larger."""
        largest = size * 100 // self.percent
        self._reach(largest)
        return range(bisect_right(self.lefts, size) - 1, bisect_right(self.lefts, largest))

    def bound(self, i: int) -> int:
        """Most columns in which two linked sets of sizes up to the range's end can differ."""
        self._reach(self.lefts[i])
        return (100 - self.percent) * 2 * (self.lefts[i + 1] - 1) // (100 + self.percent)


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text with fewer words has its sequence as one."""
    found = find_words(column, lower=True)
    rolled = sequence_hashes(found.hashes, words)
    sets = []
    for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
        if b - a >= words:
            sets.append(np.unique(rolled[a : b - words + 1]))
        else:
            sets.append(sequence_hashes(found.hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return sets


def block_rows(grams: np.ndarray, ranges: Ranges) -> np.ndarray:
    """Fingerprints of a document's block rows, for every range in which it looks for partners.

    With more blocks than the bound, a linked pair agrees in some block that is among the
    ``bound + 1`` fullest of either document, so sparser blocks are left out; empty blocks count
    only for documents that fill no more than ``bound`` blocks.
    """
    found = []
    mixed = mix(grams)
    high = grams >> np.uint64(32)
    for i in ranges.of(len(grams)):
        bound = ranges.bound(i)
        n = bound + 1 + (bound + 1) // 4
        block = (high * np.uint64(n)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        sizes = np.diff(np.append(first, len(grams)))
        sums = np.add.reduceat(mixed, first)
        filled = block[first]
        base = numbers(1, 1_000 + i)[0]
        if len(first) > bound:
            keep = sizes >= np.partition(sizes, len(sizes) - 1 - bound)[len(sizes) - 1 - bound]
            sums, filled = sums[keep], filled[keep]
        else:
            empty = np.setdiff1d(np.arange(n, dtype=np.uint64), filled)
            sums = np.concatenate([sums, np.full(len(empty), EMPTY_BLOCK)])
            filled = np.concatenate([filled, empty])
        found.append(mix(sums + mix(filled + base)))
    return np.concatenate(found)


def _blocks(words: int, percent: int):
    """Per chunk: ``block, member, tie``, slim rows with each block's members tied to its smallest one.

    The smallest member's row has tie 0 and meets those of other chunks; a row tied to it has minus
    the smallest member minus 1. Documents of equal sets are tied in ``TWINS`` and have no other row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(percent)
        for chunk in chunks(batches, "text"):
            rows = chunk.column("row").to_numpy()
            seen: dict[int, list[int]] = {}
            sets = shingle_sets(chunk.column("text"), words)
            prints, owners, same = [], [], []
            for i in np.argsort(rows, kind="stable").tolist():
                grams = sets[i]
                if not len(grams):
                    continue
                alike = seen.setdefault(int(mix(grams).sum()), [])
                twin = next((j for j in alike if np.array_equal(sets[j], grams)), None)
                if twin is not None:
                    same.append((rows[i], rows[twin]))
                    continue
                alike.append(i)
                found = block_rows(grams, ranges)
                prints.append(found)
                owners.append(np.full(len(found), rows[i]))
            if not prints:
                continue
            block, member = np.concatenate(prints).view(np.int64), np.concatenate(owners)
            order = np.lexsort((member, block))
            block, member = block[order], member[order]
            new = np.concatenate([[True], block[1:] != block[:-1]])
            first = np.flatnonzero(new)
            hub = member[first][np.cumsum(new) - 1]
            twins = np.array(same, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([block, np.full(len(twins), TWINS)])),
                    pa.array(np.concatenate([member, twins[:, 0]])),
                    pa.array(np.concatenate([np.where(new, 0, -hub - 1), -twins[:, 1] - 1])),
                ],
                names=["block", "member", "tie"],
            )

    return run


def profile(grams: np.ndarray) -> np.ndarray:
    """Numbers of n-grams in ranges of the hash, about eight in each, at most 255.

    The sum of the differences of two profiles is no more than the number of differing n-grams.
    """
    parts = 64
    while parts * 8 < len(grams):
        parts *= 2
    part = (grams >> np.uint64(64 - parts.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(part, minlength=parts), 255).astype(np.uint8)


def _sets(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            sets = shingle_sets(chunk.column("text"), words)
            wanted = chunk.column("wanted").to_numpy(zero_copy_only=False)
            grams = [s.view(np.int64) if w else None for s, w in zip(sets, wanted, strict=True)]
            profiles = [profile(s).tobytes() if w else None for s, w in zip(sets, wanted, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("row"),
                    chunk.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(grams, pa.list_(pa.int64())),
                    pa.array(profiles, pa.binary()),
                ],
                names=["row", "id", "n_shingles", "grams", "profile"],
            )

    return run


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a, b``) whose sizes and profiles do not rule out a link; rows carry profiles, not n-grams."""
    side = sets.filter(F.col("profile").isNotNull()).select("row", "n_shingles", "profile")
    left, right = (side.withColumnsRenamed({"row": c, "n_shingles": f"n_{c}", "profile": f"profile_{c}"}) for c in "ab")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            limits = ((100 - percent) * (n + m) // (100 + percent)).tolist()
            profiles = zip(batch.column("profile_a").to_pylist(), batch.column("profile_b").to_pylist(), limits, strict=True)
            kept = np.flatnonzero([bool(np.abs(np.subtract(*_folded([x, y]))).sum() <= limit) for x, y, limit in profiles])
            yield batch.select(["a", "b"]).take(pa.array(kept))

    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return pairs.join(left, "a").join(right, "b").filter(fits).mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a, b``) whose accumulated overlap reaches the threshold. N-grams move for possible pairs only."""
    pairs = written(_possible(pairs, sets, percent), "possible")
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "asked")
    side = sets.join(sized(asked, 16), "row", "left_semi").select("row", "n_shingles", "grams")
    left = side.select(F.col("row").alias("a"), F.col("n_shingles").alias("n"), F.col("grams").alias("x"))
    right = side.select(F.col("row").alias("b"), F.col("n_shingles").alias("m"), F.col("grams").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", "n", "m", common.alias("common"))
        .filter(F.col("common") * 100 >= (F.col("n") + F.col("m") - F.col("common")) * percent)
        .select("a", "b")
    )


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common n-grams, left by right, summed over blocks of columns."""
    grams, at, seen = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    column = np.cumsum(seen > 1) - 1
    column[seen < 2] = -1
    at = column[at]
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    counts = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(at, [low, low + COLUMNS])
        part = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        part[owner[a:b], at[a:b] - low] = 1
        counts += part[: len(left)] @ part[len(left) :].T
    return counts.astype(np.int64)


def _multiply(percent: int):
    """Links between parts inside one pair of tiles; of several between the same parts, those that join them."""

    def run(tiles: pa.Table) -> pa.Table:
        rows, part, n = (tiles.column(c).to_numpy() for c in ("row", "part", "n_shingles"))
        side = tiles.column("side").to_numpy()
        sets = [s.values.to_numpy() for s in tiles.column("grams").combine_chunks()]
        # Side 0 is the first tile, 1 the second; a tile paired with itself has side 2 only.
        one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        common = overlaps([sets[i] for i in one], [sets[i] for i in two])
        reached = common * 100 >= (n[one][:, None] + n[two][None, :] - common) * percent
        reached &= part[one][:, None] != part[two][None, :]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        for i, j in zip(*(v.tolist() for v in np.nonzero(reached)), strict=True):
            p, q = find(int(part[one[i]])), find(int(part[two[j]]))
            if p != q:
                root[max(p, q)] = min(p, q)
                found.append((rows[one[i]], rows[two[j]]))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _folded(profiles: list[bytes]) -> np.ndarray:
    """Profiles as rows of the shortest one's length: longer ones are added up in runs."""
    arrays = [np.frombuffer(p, np.uint8) for p in profiles]
    parts = min(map(len, arrays))
    return np.stack([a.reshape(parts, -1).sum(1, dtype=np.int16) if len(a) > parts else a.astype(np.int16) for a in arrays])


def _alike(percent: int):
    """Per pair of tiles, the parts that some two members may link: ``a, b`` that join them (rows come sorted by pair and side).

    Members of side 0 meet those of side 1; side 2 is a tile whose members meet each other. Two members may be linked unless the difference of its profiles exceeds the size-derived bound on
    differing n-grams. They meet here only, a bounded number at a time.
    """

    def joined(parts: np.ndarray, n: np.ndarray, side: np.ndarray, profiles: list[bytes]) -> list[tuple[int, int]]:
        rows = _folded(profiles)
        bound = (100 - percent) * (n[:, None] + n[None, :]) // (100 + percent) if len(n) <= 64 else None
        root = {int(p): int(p) for p in parts}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        second = int(np.searchsorted(side, 1))
        for i in range(len(rows) - 1 if side[0] == 2 else second):
            to = i + 1 if side[0] == 2 else second
            limit = bound[i, to:] if bound is not None else (100 - percent) * (n[i] + n[to:]) // (100 + percent)
            near = np.abs(rows[to:] - rows[i]).sum(1) <= limit
            near &= parts[to:] != parts[i]
            for other in np.unique(parts[to:][near]).tolist():
                p, q = find(int(parts[i])), find(other)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    found.append((p, q))
        return found

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _with_end(batches):
            table = pa.Table.from_batches([batch]) if batch is not None else None
            if held is not None:
                table = held if table is None else pa.concat_tables([held, table])
            if table is None or not table.num_rows:
                continue
            pair = table.column("pair").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])).tolist() + [len(pair)]
            # The last pair may go on in the next batch.
            if batch is not None:
                held, edges = table.slice(edges[-2]), edges[:-1]
            part, n, side = (table.column(c).to_numpy() for c in ("part", "n_shingles", "side"))
            profiles = table.column("profile").to_pylist()
            found = [e for a, z in zip(edges[:-1], edges[1:], strict=True) for e in joined(part[a:z], n[a:z], side[a:z], profiles[a:z])]
            pairs = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _with_end(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _paired(members: DataFrame, group: str, percent: int) -> DataFrame:
    """Members of each group once for every pair of tiles they are in: the group, ``pair, row, part, n_shingles, side``.

    ``members`` has the group, ``row, part, n_shingles``. They are dealt to tiles of about ``TILE`` rows:
    large parts to tiles of their own, which are not paired with each other, small parts together. Tile
    pairs whose sizes cannot reach the threshold are left out. Side 0 is the first tile of a pair, 1 the
    second; a tile paired with itself has side 2 only.
    """
    parts = members.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("n") > TILE
    few = parts.filter(~own).groupBy(group).agg(F.ceil(F.sum("n") / TILE).alias("mixed"))
    dealt = written(
        members.join(parts, [group, "part"])
        .join(few, group, "left")
        .select(
            group,
            "row",
            "part",
            "n_shingles",
            F.when(own, F.col("part")).otherwise(F.lit(-1)).alias("of"),
            F.when(own, F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / TILE))).otherwise(F.pmod(F.xxhash64("part"), F.col("mixed"))).alias("tile"),
        ),
        "dealt",
    )
    tiles = dealt.groupBy(group, "of", "tile").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    fits = (F.col("l.most") * 100 >= F.col("r.least") * percent) & (F.col("r.most") * 100 >= F.col("l.least") * percent)
    ordered = F.struct("l.of", "l.tile") <= F.struct("r.of", "r.tile")
    apart = (F.col("l.of") != F.col("r.of")) | (F.col("l.of") == -1)
    pairs = written(
        tiles.alias("l").join(tiles.alias("r"), group).filter(fits & ordered & apart).select(
            group,
            F.struct("l.of", "l.tile").alias("first"),
            F.struct("r.of", "r.tile").alias("second"),
        ),
        "tiles",
    )
    key = F.xxhash64(group, "first", "second").alias("pair")
    alike = F.col("first") == F.col("second")
    sides = pairs.select(group, "first", "second", F.explode(F.when(alike, F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.select(group, key, "side", F.when(F.col("side") == 1, F.col("second")).otherwise(F.col("first")).alias("t"))
    return dealt.withColumn("t", F.struct("of", "tile")).join(sides, [group, "t"]).select(group, "pair", "row", "part", "n_shingles", "side")


def _across(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different parts of the same block; ``rest`` has ``block, row, part``.

    Blocks of the same members are looked at once, large ones in pairs of tiles. Parts that some block
    holds alike by their profiles make a family, and a family's rows are multiplied out, each pair once,
    in pairs of tiles as well.
    """
    spark = rest.sparkSession
    marks = [F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit("again"))).alias("y")]
    members_of = rest.groupBy("block").agg(F.count(F.lit(1)).alias("size"), *marks)
    once = written(members_of.groupBy("size", "x", "y").agg(F.min("block").alias("block")).select("block", "size"), "once")
    sizes = sets.select("row", "n_shingles")
    met = rest.join(once.filter(F.col("size") <= TILE), "block").join(sizes, "row").select(
        F.col("block").alias("pair"), "row", "part", "n_shingles", F.lit(2).alias("side")
    )
    large = once.filter(F.col("size") > TILE)
    if large.limit(1).count():
        cut = written(rest.join(large, "block").join(sizes, "row").select("block", "row", "part", "n_shingles"), "large")
        met = met.union(_paired(cut, "block", percent).select("pair", "row", "part", "n_shingles", "side"))
    alike = (
        met.join(sets.select("row", "profile"), "row")
        .select("pair", "row", "part", "n_shingles", "side", "profile")
        .repartition(shuffle_partitions(spark), "pair")
        .sortWithinPartitions("pair", "side", "row")
        .mapInArrow(_alike(percent), "a long, b long")
    )
    chains = components(alike)
    family = chains.select(F.col("node").alias("part"), F.col("component").alias("family"))
    members = written(rest.select("row", "part").distinct().join(family, "part").join(sizes, "row"), "families")
    return (
        _paired(members, "family", percent)
        .join(sets.select("row", "grams"), "row")
        .select("family", "pair", "row", "part", "n_shingles", "side", "grams")
        .groupBy("family", "pair")
        .applyInArrow(_multiply(percent), "a long, b long")
    )


def jaccard_components(
    docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, component, row``.

    Texts are lower-cased (A-Z); n-grams are ``words`` consecutive words. Two documents are linked
    when ``100 * intersection >= percent * union`` of their distinct n-grams; a component is
    what links reach, ``component_id`` its smallest id (null only if all are) and ``component`` its
    smallest row number in the table.

    Null and empty texts, and texts of separators alone, have no n-gram and are linked with
    nothing. Repeated rows are documents of their own, linked like other copies. N-grams are
    compared by 64-bit hashes. Other columns are not read; an empty table gives an empty result.
    """
    docs = numbered(docs)
    base = docs.select(
        F.col(ROW).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    )
    emitted = base.select("row", "text").mapInArrow(_blocks(words, percent), "block long, member long, tie long")
    # Rows tied inside a chunk make groups of their own; only the hubs of a block meet across chunks.
    group = Window.partitionBy("block", "tie")
    edges = written(
        emitted.withColumn("top", F.min("member").over(group))
        .withColumn("hubs", F.count(F.lit(1)).over(group))
        .filter((F.col("tie") < 0) | (F.col("hubs") > 1))
        .select("block", "member", F.when(F.col("tie") < 0, -F.col("tie") - 1).otherwise(F.col("top")).alias("hub")),
        "blocks",
    )
    tied = written(
        edges.filter("member <> hub")
        .groupBy(F.col("hub").alias("a"), F.col("member").alias("b"))
        .agg(F.max(F.col("block") == TWINS).alias("same")),
        "pairs",
    )
    open_pairs = tied.filter(~F.col("same")).select("a", "b")
    named = written(open_pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "candidates")
    sets = written(
        base.join(sized(named.withColumn("wanted", F.lit(True)), 16), "row", "left")
        .select("row", "id", "text", F.coalesce("wanted", F.lit(False)).alias("wanted"))
        .mapInArrow(_sets(words), f"row long, id {dict(docs.dtypes)[id_col]}, n_shingles long, grams array<long>, profile binary"),
        "sets",
    )
    links = written(tied.filter("same").select("a", "b").union(_linked(open_pairs, sets, percent)), "linked")
    found = written(components(links), "components")
    # Blocks whose members are still apart (few, unless documents share passages or are near copies).
    placed = (
        edges.filter(F.col("block") != TWINS)
        .select("block", F.explode(F.array("member", "hub")).alias("row"))
        .distinct()
        .join(found.withColumnRenamed("node", "row"), "row", "left")
        .select("block", "row", F.coalesce("component", "row").alias("part"))
    )
    apart = placed.groupBy("block").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high")
    rest = written(placed.join(apart.select("block"), "block"), "apart")
    if rest.limit(1).count():
        more = written(_across(rest, sets, percent), "linked")
        found = written(components(links.union(more)), "components")
    ids = sets.select("row", "id", "n_shingles")
    member = found.withColumnRenamed("node", "row")
    smallest = ids.join(member, "row").groupBy("component").agg(F.min("id").alias("least_id"))
    return (
        ids.join(member.join(smallest, "component"), "row", "left")
        .select(
            F.col("id").alias("doc_id"),
            "n_shingles",
            F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least_id")).alias("component_id"),
            F.coalesce("component", "row").alias("component"),
            "row",
        )
    )


def drop_near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One document of each group stays, the first row of the table, with all columns; an empty table stays empty."""
    docs = numbered(docs)
    found = jaccard_components(docs, words, percent, id_col, text_col)
    return without_rows(docs, written(found.filter(F.col("component") != F.col("row")).select("row"), "near-dropped"))
