"""Sections, token windows, regrouping and chunk records.

A document is one row, and everything derived from one document (sections, windows,
ordinals, ids) is computed inside that row and then exploded. None of these operators
shuffles text, and no group can outgrow a task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import arrow
from lectern.functions import markup as M
from lectern.functions import text as X
from lectern.functions.rows import each
from lectern.operators import ordinals

METADATA = ("university_id", "program", "year", "aliases", "source_file")


@dataclass(frozen=True)
class Tokenizer:
    """Column functions between text and an array of tokens; Arrow functions fit as well."""

    encode: Callable[[Column], Column] = X.whitespace_tokens
    decode: Callable[[Column], Column] = lambda tokens: F.array_join(tokens, " ")


WHITESPACE = Tokenizer()


def plugged_tokenizer(load) -> Tokenizer:
    """Tokenizer from a loaded model; see :func:`lectern.functions.arrow.tokenizer_functions`."""
    return Tokenizer(*arrow.tokenizer_functions(load))


def split_sections(
    df: DataFrame, column: str = "text", level: int = fixed.HEADER_LEVEL, keep_preamble: bool = False
) -> DataFrame:
    """One row per section: adds ``section_idx``, ``title``, ``section``; drops the text."""
    kept = [c for c in df.columns if c != column]
    found = each(df, kept, M.sections(F.col(column), level, keep_preamble), "_s", "section_idx")
    return found.select(*kept, "section_idx", "_s.title", "_s.section")


def _check_windows(max_tokens: int, overlap: int) -> int:
    if overlap < 0 or overlap >= max_tokens:
        raise ValueError("overlap must be at least 0 and below max_tokens")
    return max_tokens - overlap


def window_count(tokens: Column, max_tokens: int, overlap: int) -> Column:
    step = _check_windows(max_tokens, overlap)
    return F.ceil(F.size(tokens) / F.lit(step)).cast("int")


def windows(tokens: Column, max_tokens: int, overlap: int) -> Column:
    """Windows starting at 0, step, 2 * step, ... below the token count."""
    step = _check_windows(max_tokens, overlap)
    starts = F.sequence(F.lit(0), window_count(tokens, max_tokens, overlap) - 1)
    found = F.transform(starts, lambda i: F.slice(tokens, i * step + 1, F.lit(max_tokens)))
    return F.when(F.size(tokens) > 0, found)  # null explodes to no rows


def chunk_tokens(
    df: DataFrame,
    column: str = "text",
    max_tokens: int = fixed.MAX_CHUNK_TOKENS,
    overlap: int = fixed.OVERLAP_TOKENS,
    tokenizer: Tokenizer = WHITESPACE,
) -> DataFrame:
    """One row per token window: adds ``window_idx``, ``chunk`` and ``n_tokens``; drops the text."""
    kept = [c for c in df.columns if c != column]
    staged = df.select(*kept, tokenizer.encode(F.col(column)).alias("_tokens"))
    # The generator emits slices, so a long document's tokens are not copied per window.
    exploded = each(staged, kept, windows(F.col("_tokens"), max_tokens, overlap), "_w", "window_idx")
    return exploded.select(
        *kept, "window_idx", tokenizer.decode(F.col("_w")).alias("chunk"), F.size("_w").alias("n_tokens")
    )


def chunk_subwords(
    df: DataFrame,
    load: Callable[[], Callable[[str], list[tuple[int, int]]]],
    column: str = "text",
    max_tokens: int = fixed.MAX_CHUNK_TOKENS,
    overlap: int = fixed.OVERLAP_TOKENS,
) -> DataFrame:
    """One row per window of subword tokens: ``window_idx``, ``chunk``, ``start_char``, ``end_char``, ``n_tokens``; drops the text.

    ``load`` runs once per Python worker and returns a function from a text to its tokens' (start, end) in code points.
    A chunk is cut from the text, from its first token to the next window's bound, and not decoded from ids: no character
    is lost or changed, and with ``overlap`` 0 the chunks of a text joined give the text. A character of several tokens is
    not cut, so windows may end a few tokens early. Null and empty texts and texts without tokens give no rows. The tokens of one
    text are held by its task at a time.
    """
    step = _check_windows(max_tokens, overlap)
    kept = [c for c in df.columns if c != column]
    staged = df.select(*kept, arrow.subword_windows(load, max_tokens, step)(F.col(column)).alias("_windows"))
    return each(staged, kept, F.col("_windows"), "_w", "window_idx").select(*kept, "window_idx", "_w.*")


def fixed_pieces(df: DataFrame, column: str = "text", size: int = 50, tokenizer: Tokenizer = WHITESPACE) -> DataFrame:
    """Non-overlapping pieces of ``size`` tokens."""
    return chunk_tokens(df, column, size, 0, tokenizer)


def piece_arrays(df: DataFrame, column: str = "text", size: int = 50) -> DataFrame:
    """Adds ``pieces``: the text's consecutive pieces as one array, for regrouping."""
    staged = df.withColumn("_tokens", X.whitespace_tokens(F.col(column)))
    joined = F.transform(windows(F.col("_tokens"), size, 0), lambda w: F.array_join(w, " "))
    return staged.withColumn("pieces", joined).drop("_tokens", column)


def even_splits(pieces: Column, every: int = 10) -> Column:
    """Split points at every ``every`` pieces: the result when no boundary is proposed."""
    n = F.size(pieces)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(every))).otherwise(F.array().cast("array<int>"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of the distinct lower-cased tokens of two pieces."""

    def words(t: Column) -> Column:
        return F.array_distinct(X.whitespace_tokens(F.lower(t)))

    pair = F.struct(words(a).alias("a"), words(b).alias("b"))
    return X.bind(
        pair,
        lambda p: X.bind(
            F.size(F.array_intersect(p["a"], p["b"])),
            lambda common: common / F.greatest(F.size(p["a"]) + F.size(p["b"]) - common, F.lit(1)),
        ),
    )


def semantic_splits(
    pieces: Column, threshold: float = 0.05, scorer: Callable[[Column, Column], Column] = jaccard
) -> Column:
    """Start of every piece whose score against the previous piece is below the threshold."""
    cut = F.filter(
        F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: scorer(F.get(pieces, i - 1), F.get(pieces, i)) < threshold,
    )
    return F.concat(F.array(F.lit(0)), cut)


def proposed_splits(pieces: Column, load, **options) -> Column:
    """Split points asked from a loaded function, with the fixed fallbacks when it fails."""
    return arrow.split_proposer(load, **options)(pieces)


def merge_at_splits(df: DataFrame, splits: Column, pieces: str = "pieces") -> DataFrame:
    """One row per run of pieces between split points: ``group_idx``, ``chunk``; blank runs are dropped."""
    kept = [c for c in df.columns if c != pieces]
    n = F.size(pieces)
    inner = F.filter(splits, lambda s: (s > 0) & (s < n))
    staged = df.withColumn("_from", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), inner))))
    runs = F.transform(
        F.col("_from"),
        lambda start, i: F.trim(
            F.array_join(F.slice(F.col(pieces), start + 1, F.coalesce(F.get(F.col("_from"), i + 1), n) - start), " ")
        ),
    )
    full = F.filter(runs, lambda r: r != "")
    return each(staged, kept, full, "chunk", "group_idx")


def chunk_stats(df: DataFrame, column: str = "chunk", by: list[str] | None = None, method: str = "character") -> DataFrame:
    """Count and average, least, greatest and total size, in characters or tokens."""
    sized = df.select(*(by or []), X.token_count(F.col(column), method).alias("_size"))
    return sized.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.avg("_size").alias("avg_size"),
        F.min("_size").alias("min_size"),
        F.max("_size").alias("max_size"),
        F.sum("_size").alias("total_size"),
    )


def overlap_length(a: Column, b: Column) -> Column:
    """Longest suffix of array ``a`` that is a prefix of array ``b``.

    Only lengths whose suffix starts with b's first element are compared in full.
    """
    longest = F.least(F.size(a), F.size(b))
    lengths = F.when(longest > 0, F.sequence(F.lit(1), longest)).otherwise(F.array().cast("array<int>"))
    first = F.get(b, F.lit(0))
    fits = F.filter(
        lengths,
        lambda n: F.when(F.get(a, F.size(a) - n) == first, F.slice(a, F.size(a) - n + 1, n) == F.slice(b, F.lit(1), n))
        .otherwise(F.lit(False)),
    )
    return F.coalesce(F.array_max(fits), F.lit(0))


def chunk_overlap(df: DataFrame, doc: str, index: str, column: str = "chunk", method: str = "whitespace") -> DataFrame:
    """(doc, index, overlap) between each chunk and the next of its document.

    Neighbours meet through an equi-join on (document, index), which stays even when one
    document holds most chunks; a window per document would not.
    """
    units = X.whitespace_tokens(F.col(column)) if method == "whitespace" else F.split(F.col(column), "")
    left = df.select(doc, F.col(index).cast("long").alias(index), units.alias("_a"))
    right = df.select(doc, (F.col(index).cast("long") - 1).alias(index), units.alias("_b"))
    return left.join(right, [doc, index]).select(doc, index, overlap_length(F.col("_a"), F.col("_b")).alias("overlap"))


def assign_chunk_ids(
    df: DataFrame,
    order: list[str],
    source: str = "source_file",
    prefix: tuple[str, ...] = ("university_id", "program", "year"),
) -> DataFrame:
    """Ids ``<univ>_<program>_<year>_chunk_<n>``; n runs over the source file from 1."""
    numbered = ordinals.running_number(df, [source], order, "_n")
    return numbered.withColumn(
        "chunk_id", F.concat_ws("_", *prefix, F.lit("chunk"), F.col("_n").cast("string"))
    ).drop("_n")


# ---- section records -------------------------------------------------------------


def _table_text(source: Column) -> Column:
    rows = F.filter(M.table_rows(source), lambda r: F.size(r) > 0)
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def section_context(texts: Column, i: Column, lookback: int = 3, n: int = 3) -> Column:
    """Last sentences of the nearest of the preceding sections that has text."""
    start = F.greatest(i - lookback, F.lit(0))
    before = F.slice(texts, start + 1, F.least(i, F.lit(lookback)))
    said = F.filter(before, lambda t: t != "")
    return F.when(F.size(said) > 0, X.last_sentences(F.element_at(said, -1), n)).otherwise(F.lit(""))


def section_records(
    docs: DataFrame, column: str = "text", level: int = 1, lookback: int = 3, sentences: int = 3
) -> DataFrame:
    """Section fields: plain text, tables, flags, context and the text to embed.

    A section with tables is given the last sentences of the nearest preceding section
    with text, looking back over the document's section array.
    """
    kept = [c for c in docs.columns if c != column]
    docs = docs.withColumn(column, arrow.readable_markup(F.col(column)))
    staged = docs.select(*kept, M.sections(F.col(column), level).alias("_sections"))
    staged = staged.withColumn("_texts", F.transform("_sections", lambda s: M.plain_text(s["section"])))
    staged = staged.withColumn(
        "_rows",
        F.transform(
            "_sections",
            lambda s, i: F.struct(
                s["title"].alias("title"),
                s["section"].alias("raw_markdown"),
                F.get("_texts", i).alias("text"),
                M.table_sources(s["section"]).alias("_sources"),
                section_context(F.col("_texts"), i, lookback, sentences).alias("_context"),
            ),
        ),
    )
    rows = each(staged, kept, F.col("_rows"), "_r", "_i").select(*kept, (F.col("_i") + 1).alias("id"), "_r.*")
    shown = rows.withColumn("tables_text", F.transform("_sources", _table_text)).withColumn(
        "is_table", F.size("_sources") > 0
    )
    shown = shown.withColumn("has_context", F.col("is_table") & (F.col("_context") != ""))
    body = F.concat(F.col("title"), F.lit("\n\n"), F.col("text"), F.lit("\n\n"), F.array_join("tables_text", "\n\n"))
    lead = F.when(F.col("has_context"), F.concat(F.lit("Context: "), F.col("_context"), F.lit("\n\n"))).otherwise("")
    return shown.select(
        *kept,
        "id",
        "title",
        "raw_markdown",
        "text",
        F.transform("_sources", lambda s: F.replace(s, F.lit(M.ROW_MARK), F.lit("\n"))).alias("tables_html"),
        "tables_text",
        X.strip(F.concat(lead, body)).alias("concatenated_text"),
        "is_table",
        "has_context",
        F.when(F.col("has_context"), F.col("_context")).otherwise("").alias("context"),
    )


# ---- paragraph chunks ------------------------------------------------------------


def build_chunks(
    docs: DataFrame,
    column: str = "text",
    level: int = fixed.HEADER_LEVEL,
    max_tokens: int = fixed.MAX_CHUNK_TOKENS,
    overlap: int = fixed.OVERLAP_TOKENS,
) -> DataFrame:
    """Paragraph chunks of documents that carry the metadata columns.

    Sections, plain text, windows and the running chunk number all come from the
    document's own row: windows per section are counted first, so every section knows how
    many chunks precede it and the ids need no window over the document.
    """
    meta = [c for c in METADATA if c in docs.columns]
    docs = docs.withColumn(column, arrow.readable_markup(F.col(column)))
    staged = docs.select(*meta, M.sections(F.col(column), level).alias("_sections"))
    staged = staged.withColumn(
        "_tokens", F.transform("_sections", lambda s: X.whitespace_tokens(M.plain_text(s["section"])))
    )
    staged = staged.withColumn("_counts", F.transform("_tokens", lambda t: window_count(t, max_tokens, overlap)))
    staged = staged.withColumn(
        "_parts",
        F.transform(
            "_sections",
            lambda s, i: F.struct(
                s["title"].alias("section_title"),
                F.get("_tokens", i).alias("tokens"),
                F.aggregate(F.slice("_counts", F.lit(1), i), F.lit(0), lambda acc, n: acc + n).alias("before"),
            ),
        ),
    )
    parts = each(staged, meta, F.col("_parts"), "_p", "section_idx")
    kept = [
        *meta,
        "section_idx",
        F.col("_p.section_title").alias("section_title"),
        F.col("_p.before").alias("_before"),
    ]
    cut = each(parts, kept, windows(F.col("_p.tokens"), max_tokens, overlap), "_w", "window_idx")
    numbered = cut.withColumn("text", F.array_join("_w", " ")).withColumn(
        "chunk_index", F.col("_before") + F.col("window_idx")
    )
    return numbered.select(
        F.concat_ws(
            "_", "university_id", "program", "year", F.lit("chunk"), (F.col("chunk_index") + 1).cast("string")
        ).alias("chunk_id"),
        "text",
        X.first_sentence_summary(F.col("text")).alias("summary"),
        "section_title",
        "section_idx",
        "window_idx",
        "chunk_index",
        *meta,
        F.lit("paragraph").alias("chunk_type"),
    )
