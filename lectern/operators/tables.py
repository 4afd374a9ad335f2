"""Tables inside markdown sections: extraction, cells, context, rendering, records.

Like the sections they come from, tables stay in their document's row until they are
exploded; positions and running numbers need no window and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import arrow
from lectern.functions import markup as M
from lectern.functions import text as X
from lectern.functions.rows import each
from lectern.operators.chunking import METADATA


def _tables(section: Column) -> Column:
    """array<struct<table_idx, source, position>> with the true character position of each table."""

    def locate(parts: Column) -> Column:
        def before(n: Column) -> Column:
            return F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda acc, s: acc + F.length(s))

        return F.transform(
            F.filter(parts, lambda _, i: i % 2 == 1),
            lambda source, i: F.struct(
                i.alias("table_idx"), source.alias("source"), before(2 * i + 1).alias("position")
            ),
        )

    return X.bind(M.cut_at_tables(section), locate)


def extract_tables(sections: DataFrame, column: str = "section") -> DataFrame:
    """One row per HTML or pipe table: ``table_idx``, ``source``, ``position`` in the section.

    The section comes back as it was read: rarer entities decoded, nested tables behind their outer one,
    U+FFFD in place of the control characters U+0001 to U+0005.
    """
    sections = sections.withColumn(column, arrow.readable_markup(F.col(column)))
    found = each(sections, sections.columns, _tables(F.col(column)), "_t")
    return found.select(*sections.columns, "_t.*")


def table_text(source: Column) -> Column:
    """The table as it stands in the text."""
    return F.replace(source, F.lit(M.ROW_MARK), F.lit("\n"))


def with_rows(tables: DataFrame) -> DataFrame:
    """Adds ``header`` and ``body`` (arrays of cell texts) to extracted tables."""
    staged = tables.withColumn("_rows", M.table_rows(F.col("source")))
    return staged.withColumns({"header": M.table_header(F.col("_rows")), "body": M.table_body(F.col("_rows"))}).drop(
        "_rows"
    )


def table_cells(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Long form (keys, row_idx, col_idx, header, value); duplicate headers keep all their cells."""
    rows = each(with_rows(tables), [*keys, "header"], F.col("body"), "_cells", "row_idx")
    named = rows.withColumn("_names", M.column_names(F.col("header"), F.size("_cells")))
    cells = F.arrays_zip(F.col("_names").alias("header"), M.padded(F.col("_cells"), F.size("_names")).alias("value"))
    return each(named, [*keys, "row_idx"], cells, "_c", "col_idx").select(
        *keys, "row_idx", "col_idx", "_c.header", "_c.value"
    )


def table_row_maps(tables: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_idx, cells map): a repeated header keeps its last value."""
    rows = each(with_rows(tables), [*keys, "header"], F.col("body"), "_cells", "row_idx")
    entries = M.row_entries(F.col("header"), F.col("_cells"))
    pairs = F.transform(entries, lambda e: F.struct(e["name"], e["value"]))
    return rows.select(*keys, "row_idx", F.map_from_entries(pairs).alias("cells"))


def _surroundings(section: Column, position: Column, source: Column, n: int, window: int, sentences: int) -> Column:
    before = F.substring(section, F.lit(1), position)
    after = F.substring(section, position + F.length(source) + 1, F.length(section))
    start = F.greatest(position - window, F.lit(0))
    near = F.substring(section, start + 1, position + window - start)
    near = F.regexp_replace(near, r"(?m)^#+\s+", "")
    return F.struct(
        M.paragraphs_before(before, n).alias("preceding"),
        M.paragraphs_after(after, n).alias("following"),
        X.strip(F.regexp_replace(near, r"\n\s*\n+", "\n\n")).alias("document_context"),
        X.last_sentences(before, sentences).alias("context_paragraph"),
    )


def table_context(tables: DataFrame, n: int = 2, window: int = 500, sentences: int = 3) -> DataFrame:
    """Adds paragraphs before and after, the surrounding window, and the sentences before each table."""
    around = _surroundings(F.col("section"), F.col("position"), F.col("source"), n, window, sentences)
    return tables.withColumn("_around", around).select(*tables.columns, "_around.*")


def render_markdown(tables: DataFrame) -> DataFrame:
    """Adds ``markdown`` to tables that have ``header`` and ``body``."""
    return tables.withColumn("markdown", M.render_markdown(F.col("header"), F.col("body")))


def description(title: Column, header: Column, preceding: Column) -> Column:
    n = F.size(header)
    named = F.concat(
        F.array_join(F.slice(header, 1, 3), ", "),
        F.when(n > 3, F.concat(F.lit(" and "), (n - 3).cast("string"), F.lit(" other columns"))).otherwise(""),
    )
    lead = F.when(
        preceding != "", F.concat(F.get(F.split(preceding, r"\."), F.lit(0)), F.lit("."))
    ).otherwise("")
    return F.concat(
        F.lit("Table in section '"),
        title,
        F.lit("' containing information about "),
        F.when(n > 0, named).otherwise(F.lit("various data fields")),
        F.lit(". "),
        lead,
    )


def describe_tables(tables: DataFrame) -> DataFrame:
    """Adds a description made of the section title, the first headers and the preceding sentence."""
    return tables.withColumn("description", description(F.col("title"), F.col("header"), F.col("preceding")))


def sample_rows(header: Column, body: Column, n: int = 3) -> Column:
    """First rows as ``name: value`` lines, for a description prompt."""
    lines = F.transform(
        F.slice(body, 1, n),
        lambda r: F.array_join(
            F.transform(
                M.row_entries(header, r), lambda e: F.concat(e["name"], F.lit(": "), e["value"])
            ),
            ", ",
        ),
    )
    return F.when(F.size(body) > 0, F.array_join(lines, "\n")).otherwise(F.lit("No data rows"))


def document_tables(docs: DataFrame, column: str = "text", level: int = fixed.HEADER_LEVEL) -> DataFrame:
    """Tables of whole documents with ``section_idx``, ``title``, ``section`` and ``table_no``.

    ``table_no`` runs over the document from 1; it is added up from the tables of the
    preceding sections in the document's row.
    """
    kept = [c for c in docs.columns if c != column]
    docs = docs.withColumn(column, arrow.readable_markup(F.col(column)))
    staged = docs.select(*kept, M.sections(F.col(column), level).alias("_sections"))
    staged = staged.withColumn("_found", F.transform("_sections", lambda s: _tables(s["section"])))
    staged = staged.withColumn(
        "_parts",
        F.transform(
            "_sections",
            lambda s, i: F.struct(
                s["title"].alias("title"),
                s["section"].alias("section"),
                F.get("_found", i).alias("tables"),
                F.aggregate(F.slice("_found", F.lit(1), i), F.lit(0), lambda acc, t: acc + F.size(t)).alias("before"),
            ),
        ),
    )
    rows = each(staged, kept, F.col("_parts"), "_p", "section_idx")
    before = [*kept, "section_idx", "_p.title", "_p.section", F.col("_p.before").alias("_before")]
    found = each(rows, before, F.col("_p.tables"), "_t")
    columns = [*kept, "section_idx", "title", "section"]
    return found.select(*columns, "_t.*", (F.col("_before") + F.col("_t.table_idx") + 1).alias("table_no"))


def build_table_chunks(docs: DataFrame, column: str = "text", level: int = fixed.HEADER_LEVEL) -> DataFrame:
    """One record per table: heading, description, markdown and context in one text."""
    meta = [c for c in METADATA if c in docs.columns]
    found = describe_tables(render_markdown(with_rows(table_context(document_tables(docs, column, level)))))
    combined = F.concat(
        F.lit("# "), F.col("title"),
        F.lit("\n\n## Table Description\n"), F.col("description"),
        F.lit("\n\n## Table Data\n"), F.col("markdown"),
        F.lit("\n\n## Context\n"), F.col("preceding"),
    )
    return found.select(
        F.concat_ws(
            "_",
            F.coalesce("university_id", F.lit("UNK")),
            F.coalesce("program", F.lit("UNK")),
            F.lit("table"),
            F.col("table_no").cast("string"),
        ).alias("table_id"),
        table_text(F.col("source")).alias("original_html"),
        F.col("markdown").alias("markdown_format"),
        F.col("description").alias("contextual_description"),
        combined.alias("combined_chunk"),
        F.col("title").alias("section_title"),
        "section_idx",
        F.col("table_idx").alias("table_index"),
        *meta,
    )


def build_table_rows(docs: DataFrame, column: str = "text", level: int = fixed.HEADER_LEVEL) -> DataFrame:
    """One record per table row. The section ordinal keeps row ids unique in a document."""
    meta = [c for c in METADATA if c in docs.columns]
    found = with_rows(table_context(document_tables(docs, column, level)))
    kept = [*meta, "section_idx", "title", "table_idx", "source", "context_paragraph", "header"]
    rows = each(found, kept, F.col("body"), "_cells", "row_index")
    entries = M.row_entries(F.col("header"), F.col("_cells"))
    pairs = F.transform(entries, lambda e: F.concat(e["name"], F.lit(": "), e["value"]))
    texts = rows.withColumn("text_fallback", F.array_join(pairs, " | "))
    return texts.select(
        F.concat_ws(
            "_", "university_id", "program", "year",
            F.lit("section"), (F.col("section_idx") + 1).cast("string"),
            F.lit("table"), (F.col("table_idx") + 1).cast("string"),
            F.lit("row"), (F.col("row_index") + 1).cast("string"),
        ).alias("row_id"),
        table_text(F.col("source")).alias("table_html"),
        "text_fallback",
        "context_paragraph",
        X.first_sentence_summary(F.col("text_fallback")).alias("summary"),
        F.col("title").alias("section_title"),
        "section_idx",
        "table_idx",
        "row_index",
        *meta,
        F.lit("table_row").alias("chunk_type"),
    )


def export_for_embedding(table_chunks: DataFrame) -> DataFrame:
    """(id, text, metadata) of unified table chunks."""
    meta = [c for c in METADATA if c in table_chunks.columns]
    return table_chunks.select(
        F.col("table_id").alias("id"),
        F.col("combined_chunk").alias("text"),
        F.struct(
            *meta,
            "section_title",
            "table_index",
            F.lit("table_chunk").alias("chunk_type"),
            (F.coalesce(F.col("contextual_description"), F.lit("")) != "").alias("has_description"),
            "markdown_format",
        ).alias("metadata"),
    )
