from pyspark.sql import functions as F

from lectern.functions import markup as M
from lectern.operators import chunking, embedding, tables

PIPE = """
## Course Prerequisites

The following table shows the prerequisite courses for advanced programs.

| Course Code | Course Name | Prerequisites | Credits |
|-------------|-------------|---------------|---------|
| BCOR 260 | Financial Accounting | BCOR 130 | 3 |
| BCOR 270 | Management Accounting | BCOR 260 | 3 |
| BCOR 350 | Corporate Finance | BCOR 260, MATH 200 | 4 |

Students must complete all prerequisite courses before enrolling.
"""


def docs(spark, *values):
    rows = [(f"{i}.md", "U", "P", "2024", ["x"], v) for i, v in enumerate(values)]
    schema = "source_file string, university_id string, program string, year string, aliases array<string>, text string"
    return spark.createDataFrame(rows, schema).coalesce(1)


def found(spark, text, level=2):
    return tables.extract_tables(chunking.split_sections(docs(spark, text), level=level))


def test_text_before_the_first_header_is_dropped(spark):
    text = "intro\n## One\na\n### inner\nb\n## Two \nc"
    rows = chunking.split_sections(docs(spark, text)).orderBy("section_idx").collect()
    assert [(r["title"], r["section"]) for r in rows] == [("One", "## One\na\n### inner\nb"), ("Two", "## Two \nc")]
    kept = chunking.split_sections(docs(spark, text), keep_preamble=True).orderBy("section_idx").collect()
    assert [r["title"] for r in kept] == ["", "One", "Two"]


def test_text_without_headers_is_one_section(spark):
    [row] = chunking.split_sections(docs(spark, "  just text\n")).collect()
    assert (row["title"], row["section"]) == ("", "just text")


def test_header_levels(spark):
    text = "# A\nx\n## B\ny\n### C\nz"
    for level, titles in ((1, ["A"]), (2, ["B"]), (3, ["C"])):
        assert [r["title"] for r in chunking.split_sections(docs(spark, text), level=level).collect()] == titles


def test_pipe_table(spark):
    df = found(spark, PIPE)
    cells = tables.table_cells(df, ["source_file", "table_idx"])
    assert cells.count() == 12
    assert cells.filter("row_idx = 2 AND header = 'Prerequisites'").first()["value"] == "BCOR 260, MATH 200"
    [context] = tables.table_context(df).collect()
    assert context["preceding"] == "The following table shows the prerequisite courses for advanced programs."
    assert context["following"] == "Students must complete all prerequisite courses before enrolling."
    [row] = tables.render_markdown(tables.with_rows(df)).collect()
    assert row["markdown"].split("\n")[0] == "| Course Code | Course Name           | Prerequisites      | Credits |"


def test_rendered_table_is_extracted_again(spark):
    once = tables.render_markdown(tables.with_rows(found(spark, PIPE))).first()["markdown"]
    again = tables.render_markdown(tables.with_rows(found(spark, f"## T\n\n{once}\n"))).first()["markdown"]
    assert once == again


def test_equal_tables_have_their_own_positions(spark):
    table = "<table><tr><td>a</td></tr><tr><td>1</td></tr></table>"
    text = f"## T\n\nFirst.\n\n{table}\n\nSecond.\n\n{table}"
    rows = tables.table_context(found(spark, text)).orderBy("table_idx").collect()
    assert [r["position"] for r in rows] == [text.index(table), text.rindex(table)]
    assert rows[0]["preceding"] == "First."
    assert rows[1]["preceding"].endswith("Second.")


def test_rows_are_padded_cut_and_skipped(spark):
    table = '<TABLE class="x"><tr><th>A</th><th>B</th></tr><tr></tr><tr><td>1</td></tr><tr><td>2<td>3</td><td>4</td></tr></TABLE>'
    rows = tables.table_row_maps(found(spark, table), ["table_idx"]).orderBy("row_idx").collect()
    assert [r["cells"] for r in rows] == [{"A": "1", "B": ""}, {"A": "2", "B": "3"}]


def test_repeated_headers(spark):
    df = found(spark, "<table><tr><td>K</td><td>K</td></tr><tr><td>1</td><td>2</td></tr></table>")
    assert tables.table_row_maps(df, ["table_idx"]).first()["cells"] == {"K": "2"}
    assert tables.table_cells(df, ["table_idx"]).count() == 2


def test_table_without_header_cells(spark):
    df = found(spark, "<table><tr></tr><tr><td>1</td><td>2</td></tr></table>")
    assert tables.table_row_maps(df, ["table_idx"]).first()["cells"] == {"col_0": "1", "col_1": "2"}
    rendered = tables.render_markdown(tables.with_rows(df)).first()["markdown"]
    assert rendered.startswith("| Column 1 | Column 2 |")


def test_cell_markup_and_entities(spark):
    df = found(spark, "<table><tr><th>A &amp; B</th></tr><tr><td> x <b>y</b><br>z &lt;&nbsp;1 </td></tr></table>")
    assert tables.table_row_maps(df, ["table_idx"]).first()["cells"] == {"A & B": "xyz <\u00a01"}


def test_long_pipe_table(spark):
    # One line per row would overflow the stack of a recursive pattern.
    body = "".join(f"| {i} | {i} |\n" for i in range(30_000))
    df = found(spark, f"## Long\n\n| a | b |\n|---|---|\n{body}")
    assert tables.table_cells(df, ["table_idx"]).count() == 60_000


def test_table_numbers_run_over_the_document(spark):
    t = "<table><tr><td>h</td></tr><tr><td>v</td></tr></table>"
    text = f"## A\n\n{t}\n\n{t}\n\n## B\n\nno table\n\n## C\n\n{t}"
    ids = [r["table_id"] for r in tables.build_table_chunks(docs(spark, text)).orderBy("table_id").collect()]
    assert ids == ["U_P_table_1", "U_P_table_2", "U_P_table_3"]
    row_ids = [r["row_id"] for r in tables.build_table_rows(docs(spark, text)).collect()]
    assert len(set(row_ids)) == 3


def test_plain_text(spark):
    text = "## Title\n\nSome **bold** and *thin* [link](http://x) ![p](q) `code`.\n\n- one\n- two\n\n5 * 3 is <b>not</b> &amp; a list"
    plain = docs(spark, text).select(M.plain_text(F.col("text")).alias("p")).first()["p"]
    assert plain.split() == "Title Some bold and thin link code. one two 5 * 3 is not & a list".split()


def test_scripts_and_comments_are_not_text(spark):
    html = "<style>p{}</style><script>var t='</p>';</script><p>a<!-- b --></p><p>c"
    assert docs(spark, html).select(M.strip_html(F.col("text")).alias("p")).first()["p"].split() == ["a", "c"]


def test_chunks_number_over_sections(spark):
    words = " ".join(f"w{i}" for i in range(500))
    chunks = chunking.build_chunks(docs(spark, f"## A\n\n{words}\n\n## B\n\nshort text.")).orderBy("chunk_index").collect()
    assert [(r["chunk_id"], r["section_title"]) for r in chunks] == [
        ("U_P_2024_chunk_1", "A"), ("U_P_2024_chunk_2", "A"), ("U_P_2024_chunk_3", "B"),
    ]
    assert chunks[2]["summary"] == "B short text.."


def test_section_context_looks_back_three_sections(spark):
    t = "<table><tr><td>h</td></tr><tr><td>v</td></tr></table>"
    text = f"# A\nOne. Two. Three. Four.\n# B\n# C\n# D\n{t}"
    rows = chunking.section_records(docs(spark, text)).orderBy("id").collect()
    assert rows[3]["is_table"] and rows[3]["has_context"]
    assert rows[3]["context"] == "C."  # a heading is text of its section
    assert rows[3]["concatenated_text"].startswith("Context: C.\n\nD")
    assert rows[0]["context"] == "" and not rows[0]["is_table"]


def test_section_summaries(spark):
    chunks = chunking.build_chunks(docs(spark, "## A\n\none. two.", "## A\n\nthree."))
    by_doc = embedding.section_summaries(chunks).orderBy("source_file").collect()
    assert [(r["text"], r["num_chunks"]) for r in by_doc] == [("A one.", 1), ("A three..", 1)]
    parts = embedding.section_summaries(chunks, by="title").orderBy("part").collect()
    assert [(r["part"], r["num_chunks"]) for r in parts] == [("0.md", 2), ("1.md", 2)]


def test_pipe_rows_with_many_trailing_blanks(spark):
    rows = ["| a | b |" + " " * 20, "|---|---|" + " " * 40, "| 1 | 2 |" + "\t" * 30, "| 3 | 4 |", "after"]
    df = spark.createDataFrame([("\n".join(rows),)], "t string")
    found = df.select(F.transform(M.table_sources(F.col("t")), M.table_rows).alias("r")).first()["r"]
    assert found == [[["a", "b"], ["1", "2"], ["3", "4"]]]


def table_cells_of(spark, text):
    df = spark.createDataFrame([(text,)], "section string")
    rows = tables.with_rows(tables.extract_tables(df)).orderBy("table_idx").collect()
    return [[r["header"], *r["body"]] for r in rows]


def test_tables_without_outer_pipes(spark):
    assert table_cells_of(spark, "a | b\n---|---\n1 | 2\n3 | 4 | 5\nlast\n\nc | d") == [[["a", "b"], ["1", "2"], ["3", "4", "5"], ["last"]]]
    assert table_cells_of(spark, "x\n\na|b\n:--|--:\n\n|c|d|\n|-|-|\n|1|2|") == [[["a", "b"]], [["c", "d"], ["1", "2"]]]
    assert table_cells_of(spark, "a | b\nno rule\n---\n1 | 2") == []


def test_fenced_code_holds_no_table(spark):
    code = "```sql\n| a | b |\n|---|---|\n<table><tr><td>x</td></tr></table>\n*kept* as is\n```"
    assert table_cells_of(spark, f"{code}\n\n| c |\n|---|\n| 1 |") == [[["c"], ["1"]]]
    df = spark.createDataFrame([(f"before *em*\n{code}\nafter",), ("~~~\n# x\n~~~",), ("```\nopen",)], "t string")
    assert [r[0] for r in df.select(M.plain_text(F.col("t"))).collect()] == [
        "before em\n\n| a | b |\n|---|---|\n<table><tr><td>x</td></tr></table>\n*kept* as is\n\nafter", "# x", "```\nopen",
    ]


def test_nested_tables_and_rare_entities(spark):
    inner = "<table class=i><tr><td>x</td><td>y &amp; z</td></tr></table>"
    text = f"<table><tr><th>k</th><th>v</th></tr><tr><td>{inner}</td><td>caf&eacute; &#169; &lt;b&gt;</td></tr></table>"
    assert table_cells_of(spark, text) == [[["k", "v"], ["x y & z", "café © <b>"]], [["x", "y & z"]]]
    twice = f"<table><tr><td>a</td></tr><tr><td>b{text}</td></tr></table>"
    assert [t[0] for t in table_cells_of(spark, twice)] == [["a"], ["k", "v"], ["x", "y & z"]]
    assert table_cells_of(spark, "<table><tr><td>a</td></tr></table> <table><tr><td>b</td></tr></table>") == [[["a"]], [["b"]]]
    docs = spark.createDataFrame([("caf&eacute; &#233;", "u", "p", "y", ["x"], "f.md")], "text string, university_id string, program string, year string, aliases array<string>, source_file string")
    assert chunking.build_chunks(docs).first()["text"] == "café é"


def test_control_characters_are_not_taken_for_marks(spark):
    marks = "\x01\x02\x03\x04\x05"
    text = f"## T\na{marks}b\n\n| x | y |\n|---|---|\n| 1{marks} | 2 |\n\n```\nc{marks}|d\n```\n"
    plain = text.replace(marks, "\ufffd" * 5)
    [row] = tables.with_rows(found(spark, text)).collect()
    [want] = tables.with_rows(found(spark, plain)).collect()
    assert row["body"] == want["body"] == [["1" + "\ufffd" * 5, "2"]]
    assert (row["position"], row["source"]) == (want["position"], want["source"])
    given, same = (chunking.section_records(docs(spark, t), level=2).first().asDict() for t in (text, plain))
    assert given == same and "a" + "\ufffd" * 5 + "b" in given["text"]
