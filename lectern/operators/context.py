"""Contexts, citations, prompts and conversation windows for many questions at once.

Hits are flat rows ``(query_id, item_id, rank, type, text, section_title, university_id,
program, year, source_file, table_html, score, combined_score, rerank_score)``. A query has
at most its top-k hits, so everything grouped by query is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import text as X
from lectern.operators.ordinals import top_rows


def _value(df: DataFrame, name: str, default: str) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def assemble_context(
    hits: DataFrame, include_metadata: bool = True, include_citations: bool = True, max_tokens: int | None = None
) -> DataFrame:
    """(query_id, context, num_sources): hits in rank order as one text per query.

    With a token budget, hits are kept while their running token count fits.
    """
    pieces: list[Column] = []
    pieces.append(F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ")) if include_citations else F.lit(" "))
    if include_metadata:
        for label, name in fixed.CONTEXT_HEADER:
            pieces += [F.lit(label), _value(hits, name, "N/A"), F.lit("\n")]
        pieces.append(F.lit(fixed.CONTEXT_RULE + "\n"))
    pieces.append(_value(hits, "text", ""))
    if "table_html" in hits.columns:
        table = (F.col("type") == "table") & F.col("table_html").isNotNull()
        pieces.append(F.when(table, F.concat(F.lit("\n\nTable:\n"), F.col("table_html"))).otherwise(F.lit("")))
    parts = hits.select("query_id", "rank", F.concat(*pieces).alias("part"))
    if max_tokens is not None:
        upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
        parts = parts.withColumn("_used", F.sum(X.token_count(F.col("part"))).over(upto)).filter(
            F.col("_used") <= max_tokens
        )
    ordered = F.array_sort(F.collect_list(F.struct("rank", "part")))
    return parts.groupBy("query_id").agg(
        F.array_join(
            F.transform(ordered, lambda e: e["part"]), f"\n\n{fixed.CONTEXT_SEPARATOR}\n\n"
        ).alias("context"),
        F.count(F.lit(1)).alias("num_sources"),
    )


def section_title(text: Column, given: Column) -> Column:
    """The given title, else a numbered heading in the text, else a heading-like line, else a default."""
    known = F.when((given != "") & (given != "Unknown"), given)
    numbered = [
        F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, p, 1), r"\s+", " ")), F.lit(""))
        for p in fixed.HEADING_PATTERNS
    ]
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 5), X.strip)
    upper = r"\p{Lu}"

    def heading(line: Column) -> Column:
        shouted = F.rlike(line, F.lit(upper)) & ~F.rlike(line, F.lit(r"[\p{Ll}\p{Lt}]"))
        dotted = F.rlike(line, F.lit("^" + upper)) & F.contains(F.substring(line, 1, 5), F.lit("."))
        return (F.length(line) > 5) & (F.length(line) < 80) & (shouted | dotted)

    prominent = F.get(F.filter(lines, heading), F.lit(0))
    return F.coalesce(known, *numbered, F.when(prominent != "Unknown", prominent), F.lit(fixed.DEFAULT_SECTION))


def infer_section(df: DataFrame, text: str = "text", given: str = "section_title") -> DataFrame:
    title = F.col(given) if given in df.columns else F.lit(None).cast("string")
    return df.withColumn("section_title", section_title(F.col(text), title))


def _best_score(hits: DataFrame) -> Column:
    names = [c for c in ("rerank_score", "combined_score", "score") if c in hits.columns]
    return F.coalesce(*[F.col(c) for c in names], F.lit(0.0))


def citations(hits: DataFrame, floor: float | None = None) -> DataFrame:
    """One citation per query and source file, best score first, numbered from 1.

    ``floor=0.0`` starts the greatest score at zero. Sections appear in order of their first
    hit; each shows its two best passages.
    """
    rows = infer_section(hits).select(
        "query_id",
        "rank",
        _value(hits, "source_file", "Unknown").alias("source_file"),
        _value(hits, "university_id", "Unknown").alias("university_id"),
        _value(hits, "program", "Unknown").alias("program"),
        _value(hits, "year", "Unknown").alias("year"),
        F.col("section_title").alias("section"),
        F.coalesce("text", F.lit("")).alias("text"),
        _best_score(hits).alias("score"),
    )
    passage = F.when(
        F.length("text") > fixed.CITATION_TEXT_LENGTH,
        F.concat(F.substring("text", 1, fixed.CITATION_TEXT_LENGTH), F.lit("...")),
    ).otherwise(F.col("text"))
    # A section's rows are hits of one query: at most k.
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "rank", passage.alias("passage"))))
    sections = rows.groupBy("query_id", "source_file", "section").agg(
        F.min("rank").alias("first_rank"),
        F.count(F.lit(1)).alias("n"),
        F.max("score").alias("score"),
        F.min_by(F.struct("university_id", "program", "year"), "rank").alias("meta"),
        F.transform(F.slice(ordered, 1, 2), lambda e: F.concat(e["passage"], F.lit("\n\n"))).alias("passages"),
    )
    body = F.concat(
        F.lit("📑 Section: "), F.col("section"), F.lit(f"\n{fixed.CITATION_SECTION_RULE}\n"),
        F.array_join("passages", ""),
        F.when(
            F.col("n") > 2,
            F.concat(F.lit("[... and "), (F.col("n") - 2).cast("string"), F.lit(" more passage(s) from this section]\n")),
        ).otherwise(F.lit("")),
        F.lit("\n"),
    )
    sources = sections.groupBy("query_id", "source_file").agg(
        F.min_by("meta", "first_rank").alias("meta"),
        F.min("first_rank").alias("first_rank"),
        F.array_sort(F.collect_set("section")).alias("sections"),
        F.sum("n").alias("chunk_count"),
        F.max("score").alias("score"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("first_rank", "section", body.alias("b")))), lambda e: e["b"]), ""
        ).alias("body"),
    )
    if floor is not None:
        sources = sources.withColumn("score", F.greatest("score", F.lit(floor)))
    name = F.replace(F.replace(F.col("source_file"), F.lit(".md"), F.lit(".pdf")), F.lit("_"), F.lit(" "))
    described = F.concat(
        F.lit("📄 "), name, F.lit("\n🏫 "), F.col("meta.university_id"), F.lit(" | 📚 "), F.col("meta.program"),
        F.lit(" | 📅 "), F.col("meta.year"), F.lit(f"\n\n{fixed.CITATION_RULE}\n\n"), F.col("body"),
    )
    numbered = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("first_rank"))
    return sources.select(
        "query_id",
        F.row_number().over(numbered).alias("id"),
        F.lit("pdf").alias("type"),
        "source_file",
        "meta.university_id",
        "meta.program",
        "meta.year",
        "sections",
        "chunk_count",
        "score",
        X.strip(described).alias("text"),
    )


def build_prompts(
    df: DataFrame,
    question: str = "question",
    context: str = "context",
    question_type: str | None = "question_type",
    language: str | None = "language",
    instructions: str | None = None,
) -> DataFrame:
    """Adds ``prompt``. Unknown types fall back to ``qa``, languages other than ``ar`` to ``en``."""
    kind = F.col(question_type) if question_type and question_type in df.columns else F.lit("qa")
    lang = F.col(language) if language and language in df.columns else F.lit("en")
    templates = {}
    for key, template in fixed.PROMPT_TEMPLATES.items():
        if instructions and key[0] == "qa":
            template = template.replace("Instructions:", f"Instructions:\n{instructions}\n-")
        templates[key] = template

    def filled(template: str) -> Column:
        # Cut the template at its placeholders, so inserted text is never searched again.
        pieces: list[Column] = []
        rest = template
        while rest:
            at = min((rest.find(p) for p in ("{context}", "{question}") if p in rest), default=-1)
            if at < 0:
                pieces.append(F.lit(rest))
                break
            pieces.append(F.lit(rest[:at]))
            if rest.startswith("{context}", at):
                pieces.append(F.coalesce(F.col(context), F.lit("")))
                rest = rest[at + len("{context}") :]
            else:
                pieces.append(F.coalesce(F.col(question), F.lit("")))
                rest = rest[at + len("{question}") :]
        return F.concat(*pieces)

    arabic = F.coalesce(lang == "ar", F.lit(False))
    choices = F.when(F.lit(False), F.lit(""))
    for name in ("comparison", "summary"):
        choices = choices.when((kind == name) & arabic, filled(templates[(name, "ar")]))
        choices = choices.when(kind == name, filled(templates[(name, "en")]))
    choices = choices.when(arabic, filled(templates[("qa", "ar")])).otherwise(filled(templates[("qa", "en")]))
    return df.withColumn("prompt", choices)


def conversation_context(
    messages: DataFrame,
    questions: DataFrame | None = None,
    n: int = 6,
    key: str = "conv_id",
    order: str = "turn",
) -> DataFrame:
    """(key, history[, question_with_context]) from each conversation's last n messages."""
    last = top_rows(messages, [key], [F.col(order).desc()], n, "_back")
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), F.col("text"), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    history = last.groupBy(key).agg(F.array_join(F.transform(ordered, lambda e: e["line"]), "").alias("history"))
    if questions is None:
        return history
    lead = F.concat(F.lit("Previous conversation:\n"), F.col("history"), F.lit("\nCurrent question:\n"))
    return questions.join(history, key, "left").withColumn(
        "question_with_context", F.concat(F.coalesce(lead, F.lit("")), F.col("question"))
    )


def running_history(messages: DataFrame, n: int = 6, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Every message with the lines of up to n messages before it.

    Each message is copied to the turns it precedes and grouped by (conversation, turn):
    groups hold at most n rows even when one conversation holds most messages. Turns must
    be consecutive numbers.
    """
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), F.col("text"), F.lit("\n"))
    sent = messages.select(
        key, F.col(order).alias("_from"), line.alias("line"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_ahead")
    )
    ordered = F.array_sort(F.collect_list(F.struct("_from", "line")))
    before = (
        sent.withColumn(order, F.col("_from") + F.col("_ahead"))
        .groupBy(key, order)
        .agg(F.array_join(F.transform(ordered, lambda e: e["line"]), "").alias("history"))
    )
    return messages.join(before, [key, order], "left").withColumn("history", F.coalesce("history", F.lit("")))


