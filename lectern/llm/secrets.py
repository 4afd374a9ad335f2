"""Secret scans with multipart credential linking (native).

Three base kinds are reported wherever they match. A weak candidate (a bare token that could be a
secret key) says little alone: it is added as ``linked`` only when complementary parts of a
credential occur within its scope, an access identifier, or an endpoint together with an assignment.
Parts are joined to candidates as intervals: the text is cut into bins as wide as the scope, parts
are reduced per bin to their first and last edge, and a candidate looks into its own and the two
neighbouring bins.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import text_or_empty, written

# Fixed patterns of the three base kinds.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
LEAST_VALUE = 8
# These two match as long as they can, so a least length drops matches and changes no other.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# A run of exactly 40 characters of base 64, which must hold capitals, small letters and digits. Only such characters bound
# it, so it may stand behind ``=`` (env files) and before a full stop, a comma, a hyphen or padding.
WEAK = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+|(?<![A-Za-z0-9.-])[A-Za-z0-9.-]+\.amazonaws\.com"
# A part speaks for a candidate if its start or its end lies at most so many code points from the candidate's start.
SCOPE = 400
KINDS = ("assign", "access", "hex", "linked")
SPANS = "array<struct<start:int,end:int>>"


def _none() -> Column:
    return F.array().cast(SPANS)


def _walk(steps: Column) -> Column:
    """Total length of (gap, length, keep) steps, and the kept ones as spans from 0."""

    def step(state: Column, s: Column) -> Column:
        start = state["at"] + s["gap"]
        end = start + s["length"]
        span = F.when(s["keep"], F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(_none())
        return F.struct(end.alias("at"), F.concat(state["found"], span).alias("found"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), _none().alias("found")), step)


def spans(text: Column, pattern: str, keep: Callable[[Column], Column] = lambda match: F.lit(True)) -> Column:
    """Leftmost non-overlapping matches as (start, end) in code points, end exclusive.

    What lies between matches comes from splitting, the matches from extraction, and both walk
    the text alike, so a match begins after the sum of all lengths before it. Sums run within blocks
    of about the root of the number of matches, then over blocks, which keeps texts of very many
    matches cheap. Matches for which ``keep`` is false are dropped after they were found.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(
        F.split(text, pattern, -1),
        matches,
        lambda gap, match: F.struct(
            F.length(gap).alias("gap"), F.length(match).alias("length"), F.coalesce(keep(match), F.lit(False)).alias("keep")
        ),
    )
    # The piece after the last match has no match; its step has no length and comes last.
    steps = F.filter(steps, lambda s: s["length"].isNotNull())

    def blocks(all_steps: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_steps))).cast("int")
        return F.transform(
            F.sequence(F.lit(0), F.ceil(F.size(all_steps) / size).cast("int") - 1),
            lambda k: _walk(F.slice(all_steps, k * size + 1, size)),
        )

    def place(walked: Column) -> Column:
        before = F.aggregate(
            walked,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda a, w: F.struct((a["at"] + w["at"]).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")),
            lambda a: a["starts"],
        )
        shifted = F.zip_with(
            walked,
            before,
            lambda w, o: F.transform(w["found"], lambda s: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end"))),
        )
        return F.flatten(shifted)

    def bound(value: Column, build: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), build), 0)

    return F.when(text.rlike(pattern), bound(bound(steps, blocks), place)).otherwise(_none())


def _long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= LEAST_VALUE


def _mixed(match: Column) -> Column:
    return match.rlike("[A-Z]") & match.rlike("[a-z]") & match.rlike("[0-9]")


def _listed(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the named span columns by start, then kind as listed, comma-joined."""

    def ranked(kind: str) -> Column:
        rank = F.lit(KINDS.index(kind)).alias("kind")
        return F.transform(kind, lambda s: F.struct(s["start"], rank, s["end"], F.lit(kind).alias("name")))

    one = F.transform(F.sort_array(F.concat(*[ranked(k) for k in kinds])), lambda s: F.concat_ws(":", s["name"], s["start"], s["end"]))
    return F.array_join(one, ",")


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """Weak candidates with complementary parts in scope: ``row, linked`` (spans)."""
    weak = found.filter(F.size("weak") > 0)
    parts = reduce(
        DataFrame.union,
        [
            weak.select("row", F.lit(k).alias("kind"), F.explode(F.concat(F.col(k)["start"], F.col(k)["end"])).alias("at"))
            for k in ("access", "endpoint", "assign")
        ],
    )
    binned = parts.groupBy("row", "kind", F.floor(F.col("at") / scope).alias("bin")).agg(
        F.min("at").alias("first"), F.max("at").alias("last")
    )
    looking = (
        weak.select("row", F.explode("weak").alias("w"))
        .select("row", "w", F.floor(F.col("w.start") / scope).alias("own"))
        .select("*", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("bin"))
    )
    near = (
        (F.col("bin") == F.col("own"))
        | ((F.col("bin") < F.col("own")) & (F.col("w.start") - F.col("last") <= scope))
        | ((F.col("bin") > F.col("own")) & (F.col("first") - F.col("w.start") <= scope))
    )

    def has(kind: str) -> Column:
        return F.max(F.col("kind") == kind)

    return (
        looking.join(binned, ["row", "bin"])
        .filter(near)
        .groupBy("row", "w")
        .agg((has("access") | (has("endpoint") & has("assign"))).alias("complete"))
        .filter("complete")
        .groupBy(F.col("row").alias("linked_row"))
        .agg(F.sort_array(F.collect_list("w")).alias("linked"))
    )


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, row, assign, access, hex, linked`` (spans in code points).

    Null text counts as empty; repeated rows are told each; other columns are not read; an empty table gives an empty
    result. Texts of any length are scanned whole, where they lie; only spans are kept and joined.
    """
    text = F.col("text")
    found = written(
        docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_or_empty(text_col).alias("text")).select(
            "doc_id",
            "row",
            spans(text, ASSIGN, _long_value).alias("assign"),
            spans(text, ACCESS).alias("access"),
            spans(text, HEX).alias("hex"),
            spans(text, WEAK, _mixed).alias("weak"),
            spans(text, ENDPOINT).alias("endpoint"),
        ),
        "secrets",
    )
    return found.join(_linked(found, scope), F.col("row") == F.col("linked_row"), "left").select(
        "doc_id", "row", "assign", "access", "hex", F.coalesce("linked", _none()).alias("linked")
    )


def digests(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans as text."""
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(KINDS[:3]), 256).alias("base_sha256"),
        _listed(KINDS).alias("spans"),
    )
