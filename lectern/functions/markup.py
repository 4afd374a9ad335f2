"""Markdown and HTML expressions over one section of text.

Supported tables: HTML ``<table>`` elements (attributes, missing closing cell and row tags,
``<th>`` or ``<td>`` headers) and markdown pipe tables, with or without outer pipes, outside
fenced code. A cell that spans rows or columns stands at every place it covers. Nested tables and rarer entities are taken care of by
``arrow.readable_markup`` before these expressions see the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions.text import bind, last_items, strip

# Consecutive pipe-table lines are joined by this mark (one character for one newline, so
# positions stay true). Each table is then one line and its pattern needs no repeated
# group, which would recurse once per table row in the regex engine.
ROW_MARK = "\u0001"
TABLE_MARK = "\u0002"
_PIPE_BREAK = r"(\|[ \t]*)\n(?=[ \t]*\|)"
HTML_TABLE = r"(?is:<table\b[^>]*>.*?</table\s*>)"
PIPE_TABLE = (
    r"(?m:^[ \t]*\|[^\n\x01]+\|[ \t]*\x01[ \t]*\|?[ \t]*:?-[-: |\t]*\|[ \t]*(?:\x01[^\n]*)?$)"
)
# A table without outer pipes is a block whose second line is a rule; it ends with the block.
_RULE = r"[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*"
_BARE_HEADER = r"^(?![ \t]*\|)[^\n\x01]*\|[^\n\x01]*"
_BARE_BREAK = rf"(?m)({_BARE_HEADER}(?=\n{_RULE}$)|\G(?<!\A)[^\n\x01]*[^\s\x01][^\n\x01]*)\n(?=[^\n]*\S)"
BARE_TABLE = rf"(?m:{_BARE_HEADER}\x01{_RULE}(?:\x01[^\n]*)?$)"
TABLE = HTML_TABLE + "|" + PIPE_TABLE + "|" + BARE_TABLE

# Fenced code, cut out by marks of its own; in it, table marks are replaced one to one.
_FENCE_MARK = "\u0003"
_FENCE = r"(?ms)(^(```|~~~)[^\n]*$.*?^\2[ \t]*$)"
_SHIELD = ("|<", "\u0004\u0005")


def has_fence(text: Column) -> Column:
    return F.contains(text, F.lit("```")) | F.contains(text, F.lit("~~~"))


def cut_at_fences(text: Column) -> Column:
    """Text, code, text, ..., text: every second part is a fenced block with its fences."""
    return F.split(F.regexp_replace(text, _FENCE, f"{_FENCE_MARK}$1{_FENCE_MARK}"), _FENCE_MARK, -1)


def fence_content(block: Column) -> Column:
    return F.regexp_replace(block, r"(?s)\A[^\n]*\n?|\n?[^\n]*\z", "")


def shielded(section: Column) -> Column:
    """The section with nothing in fenced code that looks like a table; positions stay."""
    parts = F.transform(cut_at_fences(section), lambda p, i: F.when(i % 2 == 1, F.translate(p, *_SHIELD)).otherwise(p))
    return F.when(has_fence(section), F.array_join(parts, "")).otherwise(section)


def header_pattern(level: int) -> str:
    if level not in (1, 2, 3):
        raise ValueError("header level must be 1, 2 or 3")
    return r"(?m)^" + "#" * level + r"[ \t]+(?=\S)"


def sections(text: Column, level: int = fixed.HEADER_LEVEL, keep_preamble: bool = False) -> Column:
    """array<struct<title, section>>: one entry per header, or one untitled entry without headers."""
    mark = "#" * level
    parts = F.split(text, r"(?m)(?=^" + mark + r"[ \t]+\S)")
    title = lambda s: strip(F.regexp_extract(s, r"\A" + mark + r"[ \t]+([^\n]+)", 1))
    entries = F.transform(parts, lambda s: F.struct(title(s).alias("title"), strip(s).alias("section")))
    headed = lambda e: e["title"] != ""

    def choose(found: Column) -> Column:
        # Without headers the split leaves one untitled entry, which is the whole text.
        kept = F.filter(found, lambda e: headed(e) | (e["section"] != "")) if keep_preamble else F.filter(found, headed)
        return F.when(F.exists(found, headed), kept).otherwise(found)

    return bind(entries, choose)


def join_pipe_rows(section: Column) -> Column:
    def joined(text: Column) -> Column:
        outer = F.regexp_replace(text, _PIPE_BREAK, "$1" + ROW_MARK)
        bare = F.regexp_replace(outer, _BARE_BREAK, "$1" + ROW_MARK)
        return F.when(F.rlike(text, F.lit(rf"(?m)^{_RULE}$")), bare).otherwise(outer)

    # Both table patterns look for pipes and tags that fenced code may hold as well.
    return F.when(F.contains(section, F.lit("|")) | has_fence(section), bind(shielded(section), joined)).otherwise(section)


def table_sources(section: Column) -> Column:
    """Tables of a section in order of appearance; pipe rows still joined by the mark."""
    return F.regexp_extract_all(join_pipe_rows(section), F.lit(TABLE), F.lit(0))


def cut_at_tables(section: Column) -> Column:
    """Text, table, text, table, ..., text: the section cut around its tables in one search."""
    marked = F.regexp_replace(join_pipe_rows(section), "(" + TABLE + ")", f"{TABLE_MARK}$1{TABLE_MARK}")
    return F.split(marked, TABLE_MARK, -1)


def without_tables(section: Column) -> Column:
    return F.replace(
        F.regexp_replace(join_pipe_rows(section), TABLE, ""), F.lit(ROW_MARK), F.lit("\n")
    )


def decode_entities(text: Column) -> Column:
    decoded = text
    for entity, char in fixed.HTML_ENTITIES:
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


# Inline markdown marks and what they leave behind, applied in this order.
_INLINE = (
    (r"(?m)^#{1,6}[ \t]*([^\n]*?)[ \t]*#*$", "$1"),
    (r"!\[[^\]\n]*\]\([^)\n]*\)", ""),
    (r"\[([^\]\n]*)\]\([^)\n]*\)", "$1"),
    (r"(?s)\*{3}(.+?)\*{3}", "$1"),
    (r"(?s)\*{2}(.+?)\*{2}", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"(?sU)(?<!\w)__(?!_)(.+?)(?<!_)__(?!\w)", "$1"),
    (r"(?sU)(?<!\w)_(?!_)(.+?)(?<!_)_(?!\w)", "$1"),
    (r"`([^`\n]+)`", "$1"),
)
# Line marks count only in a block that starts with one.
_QUOTE = r"(?m)^ {0,3}> ?"
_LIST_ITEM = r"(?m)^[ \t]*(?:[-*+]|\d+\.)[ \t]+"


def strip_html(text: Column, separator: str = "\n") -> Column:
    """Text nodes of an HTML fragment: scripts, styles, comments and tags removed."""
    bare = F.regexp_replace(text, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", separator)
    bare = F.regexp_replace(bare, r"(?s)</?[A-Za-z!][^>]*>", separator)
    return decode_entities(bare)


def _strip_block(block: Column) -> Column:
    unquoted = F.when(F.rlike(block, F.lit(r"\A {0,3}> ?")), F.regexp_replace(block, _QUOTE, "")).otherwise(block)
    starts_list = F.rlike(block, F.lit(r"\A {0,3}(?:[-*+]|\d+\.)[ \t]+"))
    text = F.when(starts_list, F.regexp_replace(block, _LIST_ITEM, "")).otherwise(unquoted)
    for pattern, replacement in _INLINE:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def strip_markdown(text: Column) -> Column:
    """Text without heading, quote, list, link, emphasis and code marks, block by block."""
    blocks = F.split(text, r"\n[ \t]*\n\s*")
    return F.array_join(F.transform(blocks, _strip_block), "\n\n")


def plain_text(section: Column) -> Column:
    """Text of a markdown section without its tables, markup and markdown marks; code loses its fences only."""

    def plain(part: Column) -> Column:
        return strip(
            bind(
                strip_markdown(without_tables(part)),
                lambda bare: F.when(F.rlike(bare, F.lit("[<&]")), strip_html(bare)).otherwise(bare),
            )
        )

    parts = F.transform(
        cut_at_fences(section), lambda p, i: F.when(i % 2 == 1, decode_entities(strip(fence_content(p)))).otherwise(plain(p))
    )
    pieces = F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")
    return F.when(has_fence(section), pieces).otherwise(plain(section))


def cell_text(cell: Column) -> Column:
    """Cell content: tags and the space around them removed, entities decoded."""
    return strip(decode_entities(F.regexp_replace(cell, r"(?s)\s*<[^>]*>\s*", "")))


# Limits that browsers put on spans; a row span of 0 reaches to the last row.
_MOST_COLUMNS, _MOST_ROWS = 1_000, 65_534


def _span(tag: Column, name: str) -> Column:
    return F.coalesce(F.regexp_extract(tag, rf"(?i)\b{name}span\s*=\s*[\"']?\s*(\d{{1,9}})", 1).try_cast("int"), F.lit(1))


def spanned_rows(cells: Column, tags: Column) -> Column:
    """Rows of a table with each cell's text at every place it covers.

    A cell takes the first free place of its row. The row above hands down its places with the number of rows that
    they still cover. Spans end with the table, unreadable ones count as 1, and a place that no cell
    covers is empty where a later one in the row is covered.
    """
    place = lambda left, text: F.struct(left.cast("int").alias("left"), text.alias("text"))
    places = F.array().cast("array<struct<left:int,text:string>>")

    def cell(text: Column, tag: Column) -> Column:
        down, across = _span(tag, "row"), F.least(_span(tag, "col"), F.lit(_MOST_COLUMNS))
        down = F.when(down == 0, F.lit(_MOST_ROWS)).otherwise(F.least(down, F.lit(_MOST_ROWS)))
        return F.struct(place(down - 1, text).alias("place"), F.greatest(across, F.lit(1)).alias("across"))

    def lower(p: Column) -> Column:
        return place(p["left"] - 1, p["text"])

    def after(above: Column, done: Column) -> Column:
        return F.slice(above, F.size(done) + 1, F.size(above))

    def with_covered(above: Column, done: Column) -> Column:
        """The row so far and the covered places that follow it at once."""

        def covered(tail: Column) -> Column:
            free = F.array_position(F.transform(tail, lambda p: p["left"] > 0), F.lit(False))
            return F.concat(done, F.transform(F.slice(tail, F.lit(1), F.when(free > 0, free - 1).otherwise(F.size(tail)).cast("int")), lower))

        return bind(after(above, done), covered)

    def with_cell(above: Column, done: Column, own: Column) -> Column:
        def put(begun: Column) -> Column:
            def at(p: Column, i: Column) -> Column:
                over = F.get(above, F.size(begun) + i)
                return F.when(over["left"] > 0, lower(over)).otherwise(p)

            return F.concat(begun, F.transform(F.array_repeat(own["place"], own["across"]), at))

        return bind(with_covered(above, done), put)

    def with_rest(above: Column, done: Column) -> Column:
        def closed(tail: Column) -> Column:
            last = F.array_max(F.transform(tail, lambda p, i: F.when(p["left"] > 0, i + 1).otherwise(F.lit(0))))
            kept = F.slice(tail, F.lit(1), F.coalesce(last, F.lit(0)))
            return F.concat(done, F.transform(kept, lambda p: F.when(p["left"] > 0, lower(p)).otherwise(place(F.lit(0), F.lit("")))))

        return bind(after(above, done), closed)

    def next_row(state: Column, row: Column) -> Column:
        above = state["above"]
        own = F.aggregate(row, places, lambda done, c: with_cell(above, done, c))
        return bind(
            bind(own, lambda done: with_rest(above, done)),
            lambda done: F.struct(done.alias("above"), F.concat(state["rows"], F.array(F.transform(done, lambda p: p["text"]))).alias("rows")),
        )

    given = F.zip_with(cells, tags, lambda texts, own: F.zip_with(texts, own, cell))
    start = F.struct(places.alias("above"), F.array().cast("array<array<string>>").alias("rows"))
    return F.aggregate(given, start, next_row, lambda state: state["rows"])


def table_rows(source: Column) -> Column:
    """array<array<string>>: the cells of every row, header row first; rows without cells stay empty."""
    html_rows = F.regexp_extract_all(
        source, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr\s*>|<tr\b|</table|\z)"), F.lit(1)
    )
    cell = r"(?is)<t[hd]\b([^>]*)>(.*?)(?=</t[hd]\s*>|<t[hd]\b|\z)"

    def parts(group: int, read) -> Column:
        return F.transform(html_rows, lambda row: F.transform(F.regexp_extract_all(row, F.lit(cell), F.lit(group)), read))

    html_cells = parts(2, cell_text)
    # Only tables with a spanning cell need the place of every cell.
    spanned = F.rlike(source, F.lit(r"(?is)<t[hd]\b[^>]*\b(?:row|col)span\s*="))
    html_cells = F.when(spanned, spanned_rows(html_cells, parts(1, lambda tag: tag))).otherwise(html_cells)
    pipe_lines = F.split(source, ROW_MARK)
    pipe_rows = F.concat(
        F.slice(pipe_lines, 1, 1), F.slice(pipe_lines, F.lit(3), F.greatest(F.size(pipe_lines) - 2, F.lit(0)))
    )
    pipe_cells = F.transform(
        pipe_rows,
        lambda line: F.transform(
            F.split(F.regexp_replace(strip(line), r"^\||(?<!\\)\|$", ""), r"(?<!\\)\|"),
            lambda c: cell_text(F.replace(c, F.lit("\\|"), F.lit("|"))),
        ),
    )
    return F.when(F.rlike(source, F.lit(r"(?i)\A\s*<table")), html_cells).otherwise(pipe_cells)


def table_header(rows: Column) -> Column:
    return F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>"))


def table_body(rows: Column) -> Column:
    """Data rows that have cells."""
    body = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    return F.filter(body, lambda r: F.size(r) > 0)


def column_names(header: Column, width: Column) -> Column:
    """Header cells, or ``col_i`` for a table without a header row."""
    generated = F.when(
        width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.concat(F.lit("col_"), i.cast("string")))
    ).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(header) > 0, header).otherwise(generated)


def padded(values: Column, width: Column) -> Column:
    """Exactly ``width`` values: short rows end in empty strings, long rows are cut."""
    missing = F.greatest(width - F.size(values), F.lit(0))
    return F.slice(F.concat(values, F.array_repeat(F.lit(""), missing)), F.lit(1), width)


def row_entries(header: Column, values: Column) -> Column:
    """array<struct<name, value>> of one row; a repeated name keeps its first place and last value."""
    names = column_names(header, F.size(values))
    pairs = F.arrays_zip(names.alias("name"), padded(values, F.size(names)).alias("value"))
    return bind(
        pairs,
        lambda entries: F.transform(
            F.array_distinct(F.transform(entries, lambda e: e["name"])),
            lambda n: F.element_at(F.filter(entries, lambda e: e["name"] == n), -1),
        ),
    )


def _column_widths(names: Column, body: Column) -> Column:
    longest = lambda j: F.array_max(
        F.transform(body, lambda r: F.length(F.coalesce(F.get(r, j), F.lit(""))))
    )
    return F.transform(names, lambda n, j: F.greatest(F.length(n), F.coalesce(longest(j), F.lit(0))))


def render_markdown(header: Column, body: Column) -> Column:
    """Aligned pipe table; cells beyond the header are dropped, missing ones are blank."""
    generated = F.transform(table_header(body), lambda _, i: F.concat(F.lit("Column "), (i + 1).cast("string")))
    names = F.when(F.size(header) > 0, header).otherwise(generated)
    layout = bind(names, lambda n: F.struct(n.alias("names"), _column_widths(n, body).alias("widths")))

    def table(t: Column) -> Column:
        def line(cells: Column) -> Column:
            filled = F.zip_with(
                padded(cells, F.size(t["names"])), t["widths"], lambda c, w: F.rpad(c, w, F.lit(" "))
            )
            return F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |"))

        rules = F.transform(t["widths"], lambda w: F.repeat(F.lit("-"), w + 2))
        rule = F.concat(F.lit("|"), F.array_join(rules, "|"), F.lit("|"))
        lines = F.concat(F.array(line(t["names"]), rule), F.transform(body, line))
        return F.when(F.size(t["names"]) > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))

    return bind(layout, table)


def paragraphs(text: Column) -> Column:
    """Non-blank stripped paragraphs that are not headings."""
    parts = F.transform(F.split(strip(text), r"\n\s*\n"), strip)
    return F.filter(parts, lambda p: (p != "") & ~F.startswith(p, F.lit("#")))


def paragraphs_before(text: Column, n: int) -> Column:
    return F.array_join(last_items(paragraphs(text), n), "\n\n")


def paragraphs_after(text: Column, n: int) -> Column:
    return F.array_join(F.slice(paragraphs(text), 1, n), "\n\n")
