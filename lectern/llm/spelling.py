"""Spelling variants: words one edit apart, found by walking a trie level by level as joins.

The trie of all words is a table of edges (node, label, child), where a node is the prefix that leads
to it. The first levels take one code point each, later ones blocks that double in length, so the number of levels
grows with the logarithm of the longest word. A state (word, position, node, edits) says that the first
``position`` code points of the word lead to the node with so many edits. Each level joins the states with the edges
of that level; states that reach an end after exactly one edit are neighbours. An insertion is the
deletion seen from the longer word, and a replacement is walked towards the larger code point only, so
each pair is found once and then written in both directions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BROADCAST_BYTES, text_or_empty, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS = "[a-zÀ-ÿ]+"
DROP_EVERY = 199
# Ends a word in the trie; no word holds it.
END = "."
SINGLE_LEVELS, FIRST_BLOCK = 8, 4
# Bytes of an edge in memory besides its node and label, for the choice of a broadcast.
EDGE_BYTES = 80


def levels(longest: int) -> list[tuple[int, int]]:
    """Depth and block length of each level that spells ``longest`` code points."""
    found, depth = [], 0
    while depth < longest:
        block = 1 if len(found) < SINGLE_LEVELS else FIRST_BLOCK << (len(found) - SINGLE_LEVELS)
        found.append((depth, block))
        depth += block
    return found


def word_counts(
    docs: DataFrame, least_length: int = 6, least_count: int = 5, drop_every: int = DROP_EVERY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``word, n`` of all words with enough code points and occurrences.

    Words are maximal runs of ``A-Za-z`` and U+00C0 to U+00FF with A-Z lower-cased; where ``drop_every``
    divides the crc32 of ``<id>:<run>``, one code point of the run is left out.
    """
    run, key = F.col("run"), F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")))
    at = (F.col("key") % F.length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return (
        docs.select(F.col(id_col).cast("string").alias("id"), F.translate(text_or_empty(text_col), UPPER, LOWER).alias("text"))
        .select("id", F.explode(F.regexp_extract_all("text", F.lit(RUNS), F.lit(0))).alias("run"))
        .filter(F.length(run) >= least_length)
        .select("run", key.alias("key"))
        .select(F.when(F.col("key") % drop_every == 0, without).otherwise(run).alias("word"))
        .filter(F.length("word") >= least_length)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least_count)
    )


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), number.cast("int"))


def _has(mask: str, number: Column) -> Column:
    return F.call_function("shiftright", F.col(mask), number.cast("int")).bitwiseAND(F.lit(1)) == 1


def edge_table(words: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """``level, node, label, nexts, lengths``: all edges of the trie of ``words``.

    ``nexts`` has a bit for each code point (modulo 64) that can follow the edge, ``lengths`` one for each length
    (modulo 64) of a word beyond it, both with the end mark; they rule states out a level early.
    """
    spelled = F.col("spelled")
    places = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(d).alias("depth"), F.lit(b).alias("block")) for i, (d, b) in enumerate(steps)])
    after = F.substring(spelled, F.col("depth") + F.col("block") + 1, F.lit(1))
    return (
        words.select(F.concat("word", F.lit(END)).alias("spelled"))
        .select("spelled", F.inline(places))
        .filter(F.col("depth") < F.length(spelled))
        .groupBy(
            "level",
            F.substring(spelled, F.lit(1), F.col("depth")).alias("node"),
            F.substring(spelled, F.col("depth") + 1, F.col("block")).alias("label"),
        )
        .agg(
            F.bit_or(F.when(after == "", F.lit(0).cast("long")).otherwise(_bit(F.ascii(after) % 64))).alias("nexts"),
            F.bit_or(_bit(F.length(spelled) % 64)).alias("lengths"),
        )
    )


def _advance(states: DataFrame, edges: DataFrame, depth: int, block: int) -> DataFrame:
    """States after one level. ``states`` has ``spelled, pos, node, edits``."""
    spelled, pos, label = F.col("spelled"), F.col("pos"), F.col("label")
    size = F.length(label)
    ends = label.endswith(END)

    def piece(length: Column | int) -> Column:
        return F.substring(spelled, pos + 1, length if isinstance(length, Column) else F.lit(length))

    def follows(skipped: int) -> Column:
        """The code point behind the edge is one that the trie goes on with."""
        return ends | _has("nexts", F.ascii(F.substring(spelled, pos + size + 1 + skipped, F.lit(1))) % 64)

    def reaches(shorter: Column | int) -> Column:
        return _has("lengths", (F.length(spelled) - shorter) % 64)

    same, longer = piece(size), piece(size + 1)
    matched = same == label
    replaced = (
        (same < label)
        & follows(0)
        & reaches(0)
        & (F.length(same) == size)
        & (ends == same.endswith(END))
        & (F.levenshtein(same, label, 1) == 1)
    )
    # Deleting the last code point of a piece is left to the next level, as deleting its first one.
    deleted = (
        follows(1)
        & reaches(1)
        & (F.length(longer) == size + 1)
        & (ends == longer.endswith(END))
        & ~longer.startswith(label)
        & (F.levenshtein(longer, label, 1) == 1)
    )
    child, ended = F.concat("node", label).alias("node"), ends.alias("ended")
    moves = F.array(
        F.when(matched, F.struct((pos + size).alias("pos"), F.lit(0).alias("edits"))),
        F.when(replaced, F.struct((pos + size).alias("pos"), F.lit(1).alias("edits"))),
        F.when(deleted, F.struct((pos + size + 1).alias("pos"), F.lit(1).alias("edits"))),
    )
    exact, edited = states.filter("edits = 0"), states.filter("edits = 1")
    tried = (
        exact.join(edges, (exact["node"] == edges["node"]) & (matched | replaced | deleted))
        .select("spelled", F.concat(exact["node"], label).alias("node"), ended, F.explode_outer(moves).alias("move"))
        .filter("move IS NOT NULL")
        .select("spelled", "move.pos", "node", "move.edits", "ended")
    )
    goes_on = edited.withColumn("label", piece(block)).join(
        edges, ["node", "label"]
    ).filter(follows(0) & reaches(pos - depth))
    return tried.unionByName(goes_on.select("spelled", (pos + size).alias("pos"), child, "edits", ended))


def neighbours(words: DataFrame) -> DataFrame:
    """``word, near``: every two words of ``words`` that differ by one code point, in both directions.

    ``words`` has a column ``word`` of distinct non-empty words without the end mark, and is read several times.
    """
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    steps = levels(longest + 1) if longest else []
    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = written(edge_table(words, steps).repartitionByRange(partitions, "level", "node").sortWithinPartitions("level", "node"), "trie") if steps else None
    held = {}
    if steps:
        size = F.sum(F.octet_length("node") + F.octet_length("label") + EDGE_BYTES)
        held = {r["level"]: r["held"] for r in table.groupBy("level").agg(size.alias("held")).collect()}
    states = words.select(F.concat("word", F.lit(END)).alias("spelled"), F.lit(0).alias("pos"), F.lit("").alias("node"), F.lit(0).alias("edits"))
    found = []
    for level, (depth, block) in enumerate(steps):
        edges = table.filter(F.col("level") == level).drop("level")
        # The first levels have few edges, of which one may lead to most words; there states stay where they are.
        edges = F.broadcast(edges) if held.get(level, 0) <= BROADCAST_BYTES else edges
        reached = written(_advance(states, edges, depth, block), f"trie-states-{level}")
        found.append(reached.filter("ended AND edits = 1").select("spelled", "node"))
        states = reached.filter("NOT ended").drop("ended")
    pairs = words.select("word", F.col("word").alias("near")).limit(0)
    for ends in found:
        pairs = pairs.union(ends.select(*[F.expr(f"substring({c}, 1, length({c}) - 1)") for c in ("spelled", "node")]))
    return pairs.union(pairs.select("near", "word"))


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for ``words`` (``word, n``, a written table).

    The form is the near word of largest n (ties: smallest in code-point order) if that is at least
    ``ratio`` times the word's own; the root is where following forms ends. Each step multiplies n,
    so the doubling below takes a number of rounds that grows with the logarithm of the logarithm of n.
    """
    near = neighbours(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    formed = written(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(fits, F.col("best.near")).alias("form"),
            F.when(fits, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    jumps = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumps = written(
            jumps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "roots",
        )
        if not jumps.filter("moved").limit(1).count():
            break
        jumps = jumps.drop("moved")
    return formed.join(jumps.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word of ``docs`` with enough code points and occurrences: ``word, form, root, n, n_near, form_n``.

    Null and empty texts have no words; a null id never leaves a code point out. Repeated rows count as
    often as they occur, ties between forms go to the smaller word, and words of any length are compared
    whole. An empty table gives no rows. Other columns are not read.
    """
    words = written(word_counts(docs, least_length, least_count, DROP_EVERY, id_col, text_col), "words")
    return variants(words, ratio)
