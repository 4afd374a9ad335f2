"""Queries over sections and tables, on a markdown corpus rendered from ``part``.

Every part becomes one document (rendered in its own row) with a preamble, three sections,
an HTML table, a pipe table whose length depends on the part, and an HTML table with a
repeated header, a short row, an empty row and a long row. The SQL states what extraction
must return, from the columns of ``part``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import markup as M
from lectern.operators import chunking, embedding, tables
from lectern.plans.registry import Inputs, query

ROWS = "(p_size % 5 + 1)"


def rendered(t: Inputs):
    """(p_partkey, text, metadata columns), one markdown document per part."""
    part = t.part.selectExpr(
        "p_partkey",
        "p_name AS name",
        "p_brand AS brand",
        "p_type AS type",
        "p_size AS size",
        "cast(p_partkey AS string) AS key",
    )
    pipe_row = "concat('| ', i, ' | piece | ', i * size, ' | net |\\n')"
    text = f"""concat(
      'Entry ', key, ' of the catalogue.\\n\\n',
      '## ', name, ' ', key, '\\n\\n',
      name, ' is sold under ', brand, '. It belongs to the ', type, ' range!\\n\\n',
      '### Attributes\\n\\nEach row names one attribute. Values are plain.\\n\\n',
      '<table>\\n<tr><th>Attribute</th><th>Value</th></tr>\\n<tr><td>brand</td><td>', brand, '</td></tr>\\n',
      '<tr><td>type</td><td>', type, '</td></tr>\\n<tr><td>size &amp; unit</td><td><b>', size, '</b></td></tr>\\n</table>',
      '\\n\\nAsk the **supplier** for details.\\n\\n',
      '## Prices\\n\\nPrices of ', name, ' by quantity.\\n\\n',
      '| Quantity | Unit | Price | Note |\\n|---|---|---|---|\\n',
      array_join(transform(sequence(1, size % 5 + 1), i -> {pipe_row}), ''),
      '\\nSmall print follows.\\n\\n',
      '<table class="x"><tr><td>Code</td><td>Code</td></tr><tr><td>', key, '</td></tr><tr></tr>',
      '<tr><td>a</td><td>b</td><td>c</td></tr></table>\\n\\n',
      '## Notes\\n\\nNo table here for ', name, '.')"""
    return part.selectExpr(
        "p_partkey",
        "brand AS university_id",
        "type AS program",
        "'2024' AS year",
        "array(name) AS aliases",
        "concat(key, '.md') AS source_file",
        f"{text} AS text",
    )


# The same pieces in SQL.
BASE = """WITH p AS (
  SELECT p_partkey, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size, p_partkey::VARCHAR AS key,
    range(1, p_size % 5 + 2) AS steps FROM part),
src AS (SELECT *,
  E'<table>\\n<tr><th>Attribute</th><th>Value</th></tr>\\n<tr><td>brand</td><td>' || brand || E'</td></tr>\\n<tr><td>type</td><td>'
    || type || E'</td></tr>\\n<tr><td>size &amp; unit</td><td><b>' || size || E'</b></td></tr>\\n</table>' AS t0,
  E'| Quantity | Unit | Price | Note |\\n|---|---|---|---|\\n' || array_to_string(
    list_transform(steps, lambda i: '| ' || i || ' | piece | ' || (i * size) || ' | net |'), E'\\n') AS t1,
  '<table class="x"><tr><td>Code</td><td>Code</td></tr><tr><td>' || key ||
    '</td></tr><tr></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>' AS t2,
  name || ' ' || key AS title0,
  name || ' is sold under ' || brand || '. It belongs to the ' || type || ' range!' AS intro0,
  'Prices of ' || name || ' by quantity.' AS intro1 FROM p),
sec AS (SELECT *,
  '## ' || title0 || E'\\n\\n' || intro0 || E'\\n\\n### Attributes\\n\\nEach row names one attribute. Values are plain.\\n\\n'
    || t0 || E'\\n\\nAsk the **supplier** for details.' AS s0,
  E'## Prices\\n\\n' || intro1 || E'\\n\\n' || t1 || E'\\n\\nSmall print follows.\\n\\n' || t2 AS s1,
  E'## Notes\\n\\nNo table here for ' || name || '.' AS s2 FROM src),
tab AS (
  SELECT *, 0 AS section_idx, 0 AS table_idx, 1 AS table_no, title0 AS title, s0 AS section, t0 AS source FROM sec UNION ALL
  SELECT *, 1, 0, 2, 'Prices', s1, t1 FROM sec UNION ALL
  SELECT *, 1, 1, 3, 'Prices', s1, t2 FROM sec),
body AS (
  SELECT p_partkey, 0 AS section_idx, 0 AS table_idx, 0 AS row_idx, ['Attribute', 'Value'] AS header, ['brand', brand] AS cells FROM p
  UNION ALL SELECT p_partkey, 0, 0, 1, ['Attribute', 'Value'], ['type', type] FROM p
  UNION ALL SELECT p_partkey, 0, 0, 2, ['Attribute', 'Value'], ['size & unit', size::VARCHAR] FROM p
  UNION ALL SELECT p_partkey, 1, 0, i - 1, ['Quantity', 'Unit', 'Price', 'Note'],
    [i::VARCHAR, 'piece', (i * size)::VARCHAR, 'net'] FROM (SELECT *, unnest(steps) AS i FROM p)
  UNION ALL SELECT p_partkey, 1, 1, 0, ['Code', 'Code'], [key, ''] FROM p
  UNION ALL SELECT p_partkey, 1, 1, 1, ['Code', 'Code'], ['a', 'b'] FROM p)
"""
KEYS = ["p_partkey", "section_idx", "table_idx"]


def sections(t: Inputs):
    return chunking.split_sections(rendered(t).select("p_partkey", "text"))


def found(t: Inputs):
    return tables.extract_tables(sections(t))


@query(
    "sections",
    BASE
    + """SELECT p_partkey, 0 AS section_idx, title0 AS title, s0 AS section FROM sec UNION ALL
    SELECT p_partkey, 1, 'Prices', s1 FROM sec UNION ALL SELECT p_partkey, 2, 'Notes', s2 FROM sec""",
)
def split(t: Inputs):
    return sections(t)


_PLAIN0 = "intro0 || ' Attributes Each row names one attribute. Values are plain. Ask the supplier for details.'"


@query(
    "section_records",
    BASE
    + f""", r AS (
      SELECT p_partkey, 1 AS id, title0 AS title, title0 || ' ' || {_PLAIN0} AS said, 1 AS n_tables, '' AS context,
        title0 || ' ' || title0 || ' ' || {_PLAIN0} || ' Attribute | Value brand | ' || brand || ' type | ' || type
          || ' size & unit | ' || size AS full_text FROM sec UNION ALL
      SELECT p_partkey, 2, 'Prices', 'Prices ' || intro1 || ' Small print follows.', 2,
        'Attributes Each row names one attribute. Values are plain. Ask the supplier for details..',
        'Context: Attributes Each row names one attribute. Values are plain. Ask the supplier for details.. Prices Prices '
          || intro1 || ' Small print follows. Quantity | Unit | Price | Note '
          || array_to_string(list_transform(steps, lambda i: i || ' | piece | ' || (i * size) || ' | net'), ' ')
          || ' Code | Code ' || key || ' a | b | c' FROM sec UNION ALL
      SELECT p_partkey, 3, 'Notes', 'Notes No table here for ' || name || '.', 0, '',
        'Notes Notes No table here for ' || name || '.' FROM sec)
    SELECT p_partkey, id, title, said AS text, n_tables, context, full_text AS concatenated_text,
      n_tables > 0 AS is_table, context <> '' AS has_context FROM r""",
)
def section_records(t: Inputs):
    records = chunking.section_records(rendered(t).select("p_partkey", "text"), level=2)
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return records.select(
        "p_partkey",
        "id",
        "title",
        flat(F.col("text")).alias("text"),
        F.size("tables_html").alias("n_tables"),
        flat(F.col("context")).alias("context"),
        flat(F.col("concatenated_text")).alias("concatenated_text"),
        "is_table",
        "has_context",
    )


@query(
    "tables_extracted",
    BASE
    + "SELECT p_partkey, section_idx, table_idx, source, (strpos(section, source) - 1)::INT AS position FROM tab",
)
def tables_extracted(t: Inputs):
    return found(t).select(*KEYS, tables.table_text(F.col("source")).alias("source"), "position")


@query(
    "table_cells",
    BASE
    + """SELECT p_partkey, section_idx, table_idx, row_idx::INT AS row_idx, (c - 1)::INT AS col_idx, header[c] AS header, cells[c] AS value
    FROM (SELECT *, unnest(range(1, len(header) + 1)) AS c FROM body)""",
)
def table_cells(t: Inputs):
    return tables.table_cells(found(t), KEYS)


# One form of table per part, by its key: nested, without outer pipes, beside fenced code, with entities.
_FORMS = (
    "<table><tr><th>k</th><th>v</th></tr><tr><td><table><tr><td>in</td></tr></table></td><td>{}</td></tr></table>",
    "Text | no table\n\nk | v\n---|---\nin | {}\n\nafter",
    "```\n| x | y |\n|---|---|\n| 1 | 2 |\n```\n\n| k | v |\n|---|---|\n| in | {} |",
    "<table><tr><th>k</th><th>v</th></tr><tr><td>i&#110;</td><td>{} caf&eacute;&copy;</td></tr></table>",
)


def _form() -> Column:
    written = [F.concat(F.lit(before), "p_name", F.lit(after)) for before, after in (form.split("{}") for form in _FORMS)]
    return F.element_at(F.array(*written), (F.col("p_partkey") % len(_FORMS) + 1).cast("int"))


@query(
    "table_forms",
    """SELECT p_partkey, 0 AS table_idx, 0 AS row_idx, 'k' AS header, 'in' AS value FROM part
    UNION ALL SELECT p_partkey, 0, 0, 'v', p_name || CASE WHEN p_partkey % 4 = 3 THEN ' café©' ELSE '' END FROM part""",
)
def table_forms(t: Inputs):
    sections = t.part.select("p_partkey", _form().alias("section"))
    cells = tables.table_cells(tables.extract_tables(sections), ["p_partkey", "table_idx"])
    return cells.select("p_partkey", "table_idx", F.col("row_idx").cast("int").alias("row_idx"), "header", "value")


@query(
    "form_texts",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'in' WHEN 1 THEN E'Text | no table\n\nafter'
      WHEN 2 THEN E'| x | y |\n|---|---|\n| 1 | 2 |' ELSE '' END AS text FROM part WHERE p_partkey % 4 IN (1, 2)""",
)
def form_texts(t: Inputs):
    """Plain text beside tables: fenced code stays, tables go."""
    shown = t.part.filter(F.col("p_partkey") % len(_FORMS) != 0).select("p_partkey", M.plain_text(_form()).alias("text"))
    return shown.filter(F.col("text") != "")


@query(
    "table_row_maps",
    BASE
    + """SELECT p_partkey, section_idx, table_idx, row_idx::INT AS row_idx, header[c] AS name, cells[c] AS value
    FROM (SELECT *, unnest(range(1, len(header) + 1)) AS c FROM body) WHERE NOT (header[1] = 'Code' AND c = 1)""",
)
def table_row_maps(t: Inputs):
    maps = tables.table_row_maps(found(t), KEYS)
    return maps.select(*KEYS, "row_idx", F.explode("cells").alias("name", "value"))


_PRECEDING = """CASE table_no
  WHEN 1 THEN intro0 || E'\\n\\nEach row names one attribute. Values are plain.'
  WHEN 2 THEN intro1 ELSE t1 || E'\\n\\nSmall print follows.' END"""
# Sentences before a table; the split drops the mark that ends a sentence, the join adds full stops.
_SENTENCES = """CASE table_no
  WHEN 1 THEN E'It belongs to the ' || type || E' range. ### Attributes\\n\\nEach row names one attribute. Values are plain..'
  WHEN 2 THEN E'## Prices\\n\\n' || intro1 || '.'
  ELSE E'## Prices\\n\\n' || intro1 || ' ' || t1 || E'\\n\\nSmall print follows..' END"""


@query(
    "table_contexts",
    BASE
    + f"""SELECT p_partkey, section_idx, table_idx, {_PRECEDING} AS preceding,
      CASE table_no WHEN 1 THEN 'Ask the **supplier** for details.'
        WHEN 2 THEN E'Small print follows.\\n\\n' || t2 ELSE '' END AS following,
      {_SENTENCES} AS context_paragraph
    FROM tab""",
)
def table_contexts(t: Inputs):
    return tables.table_context(found(t)).select(*KEYS, "preceding", "following", "context_paragraph")


# Markdown with aligned columns, computed cell by cell.
MARKDOWN = """, wide AS (
  SELECT b.p_partkey, b.section_idx, b.table_idx, c, greatest(max(length(b.header[c])), max(length(b.cells[c]))) AS w
  FROM (SELECT *, unnest(range(1, len(header) + 1)) AS c FROM body) b GROUP BY ALL),
lines AS (
  SELECT b.p_partkey, b.section_idx, b.table_idx, b.row_idx + 1 AS line,
    '| ' || string_agg(rpad(b.cells[w.c], w.w::INT, ' '), ' | ' ORDER BY w.c) || ' |' AS txt
  FROM body b JOIN wide w USING (p_partkey, section_idx, table_idx) GROUP BY ALL
  UNION ALL
  SELECT b.p_partkey, b.section_idx, b.table_idx, -1,
    '| ' || string_agg(rpad(b.header[w.c], w.w::INT, ' '), ' | ' ORDER BY w.c) || ' |'
  FROM body b JOIN wide w USING (p_partkey, section_idx, table_idx) WHERE b.row_idx = 0 GROUP BY ALL
  UNION ALL
  SELECT p_partkey, section_idx, table_idx, 0, '|' || string_agg(repeat('-', w::INT + 2), '|' ORDER BY c) || '|'
  FROM wide GROUP BY ALL),
md AS (SELECT p_partkey, section_idx, table_idx, string_agg(txt, E'\\n' ORDER BY line) AS markdown FROM lines GROUP BY ALL)
"""


@query("tables_markdown", BASE + MARKDOWN + "SELECT * FROM md")
def tables_markdown(t: Inputs):
    return tables.render_markdown(tables.with_rows(found(t))).select(*KEYS, "markdown")


DESCRIBED = (
    """, described AS (SELECT *, """
    + _PRECEDING
    + """ AS preceding, 'Table in section ''' || title || ''' containing information about ' || CASE table_no
      WHEN 1 THEN 'Attribute, Value. ' || split_part(intro0, '.', 1) || '.'
      WHEN 2 THEN 'Quantity, Unit, Price and 1 other columns. ' || split_part(intro1, '.', 1) || '.'
      ELSE 'Code, Code. ' || split_part(t1 || E'\\n\\nSmall print follows.', '.', 1) || '.' END AS description FROM tab)
"""
)


@query("tables_described", BASE + DESCRIBED + "SELECT p_partkey, section_idx, table_idx, description FROM described")
def tables_described(t: Inputs):
    return tables.describe_tables(tables.with_rows(tables.table_context(found(t)))).select(*KEYS, "description")


TABLE_CHUNKS = (
    BASE
    + MARKDOWN
    + DESCRIBED
    + """, chunked AS (SELECT brand || '_' || type || '_table_' || table_no AS table_id, key || '.md' AS source_file,
      '# ' || title || E'\\n\\n## Table Description\\n' || description || E'\\n\\n## Table Data\\n' || markdown
        || E'\\n\\n## Context\\n' || preceding AS combined_chunk, title AS section_title, table_idx AS table_index, markdown
    FROM described JOIN md USING (p_partkey, section_idx, table_idx))
"""
)


@query(
    "table_chunks",
    TABLE_CHUNKS + "SELECT table_id, source_file, combined_chunk, section_title, table_index FROM chunked",
)
def table_chunks(t: Inputs):
    return tables.build_table_chunks(rendered(t)).select(
        "table_id", "source_file", "combined_chunk", "section_title", "table_index"
    )


@query(
    "tables_exported",
    TABLE_CHUNKS
    + """SELECT table_id AS id, source_file, combined_chunk AS text, section_title, 'table_chunk' AS chunk_type,
      true AS has_description, markdown AS markdown_format FROM chunked""",
)
def tables_exported(t: Inputs):
    exported = tables.export_for_embedding(tables.build_table_chunks(rendered(t)))
    return exported.select(
        "id",
        "text",
        "metadata.source_file",
        "metadata.section_title",
        "metadata.chunk_type",
        "metadata.has_description",
        "metadata.markdown_format",
    )


TABLE_ROWS = (
    BASE
    + """, texts AS (SELECT b.*, t.brand, t.type, t.key, t.title, t.source, """
    + _SENTENCES
    + """ AS context_paragraph,
      CASE WHEN b.header[1] = 'Code' THEN 'Code: ' || b.cells[2] ELSE array_to_string(
        list_transform(range(1, len(b.header) + 1), lambda c: b.header[c] || ': ' || b.cells[c]), ' | ') END AS text_fallback
    FROM body b JOIN tab t USING (p_partkey, section_idx, table_idx)),
rowed AS (SELECT brand || '_' || type || '_2024_section_' || (section_idx + 1) || '_table_' || (table_idx + 1) || '_row_'
    || (row_idx + 1) AS row_id, key || '.md' AS source_file, text_fallback, context_paragraph,
    trim(text_fallback) || '.' AS summary, title AS section_title, row_idx::INT AS row_index, source AS table_html FROM texts)
"""
)


@query(
    "table_rows",
    TABLE_ROWS
    + """SELECT row_id, source_file, text_fallback, context_paragraph, summary, section_title, row_index, table_html FROM rowed""",
)
def table_rows(t: Inputs):
    return tables.build_table_rows(rendered(t)).select(
        "row_id", "source_file", "text_fallback", "context_paragraph", "summary", "section_title", "row_index", "table_html"
    )


@query(
    "embedding_texts",
    TABLE_ROWS + "SELECT row_id, source_file, context_paragraph || ' ' || text_fallback AS embedding_text FROM rowed",
)
def embedding_texts(t: Inputs):
    items = tables.build_table_rows(rendered(t))
    return embedding.embedding_text(items, "standard").select("row_id", "source_file", "embedding_text")


_SUMMARIES = (
    BASE
    + """, summed AS (
      SELECT key || '.md' AS source_file, title0 AS section_title, title0 || ' ' || intro0 AS lead, 0 AS chunk_index, brand FROM sec
      UNION ALL SELECT key || '.md', 'Prices', 'Prices ' || intro1 || ' Small print follows.', 1, brand FROM sec
      UNION ALL SELECT key || '.md', 'Notes', 'Notes No table here for ' || name || '.', 2, brand FROM sec),
    cut AS (SELECT *, regexp_split_to_array(lead, '[.!?]+\\s+')[1] AS first FROM summed),
    said AS (SELECT *, CASE WHEN length(first) <= 100 THEN first || '.' ELSE substr(first, 1, 100) || '...' END AS text FROM cut)
"""
)


@query(
    "section_summaries",
    _SUMMARIES
    + """SELECT source_file, section_title, source_file || '_section_' || chunk_index AS section_id, text,
      1::BIGINT AS num_chunks, brand AS university_id FROM said""",
)
def section_summaries(t: Inputs):
    return embedding.section_summaries(chunking.build_chunks(rendered(t))).select(
        "source_file", "section_title", "section_id", "text", "num_chunks", "university_id"
    )


@query(
    "section_summaries_by_title",
    _SUMMARIES
    + """SELECT s.section_title, s.source_file AS part, s.text, g.n AS num_chunks, g.first_brand AS university_id
    FROM said s JOIN (SELECT section_title, count(*) AS n, arg_min(brand, source_file) AS first_brand FROM said GROUP BY 1) g
    USING (section_title)""",
)
def section_summaries_by_title(t: Inputs):
    return embedding.section_summaries(chunking.build_chunks(rendered(t)), by="title").select(
        "section_title", "part", "text", "num_chunks", "university_id"
    )


_BARE = "html"
for _pattern in (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>",
    r"(?s)</?[A-Za-z!][^>]*>",
):
    _BARE = f"regexp_replace({_BARE}, '{_pattern}', chr(10), 'g')"
for _entity, _char in fixed.HTML_ENTITIES:
    _BARE = f"replace({_BARE}, '{_entity}', chr({ord(_char)}))"


@query("page_texts", f"SELECT page_id, trim(regexp_replace({_BARE}, '\\s+', ' ', 'g')) AS text FROM pages")
def page_texts(t: Inputs):
    """Visible text of the raw pages."""
    return t.pages.select("page_id", F.trim(F.regexp_replace(M.strip_html(F.col("html")), r"\s+", " ")).alias("text"))
