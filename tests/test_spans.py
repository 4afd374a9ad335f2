from html.parser import HTMLParser

import pytest
from lectern.operators import tables

BOTH = """<table border=1><tr><th rowspan="2">Name</th><th colspan=2>Marks</th></tr>
<tr><th>First</th><th>Second</th></tr>
<tr><td>A</td><td rowspan='2'>10</td><td>20</td></tr>
<tr><td>B</td><td COLSPAN="1">30</td></tr>
<tr><td colspan="3">none</td></tr></table>"""


class Plain(HTMLParser):
    """The grid by a plain walk: every cell is painted on the places it covers."""

    def __init__(self):
        super().__init__()
        self.rows, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        if tag in ("td", "th"):
            self.cell = [dict(attrs), ""]
            self.rows[-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data):
        if self.cell:
            self.cell[1] += data

    def grid(self):
        places = {}
        for y, row in enumerate(self.rows):
            for attrs, text in row:
                x = min(i for i in range(10_000) if (y, i) not in places)
                down = int(attrs.get("rowspan", 1)) or len(self.rows)
                for dy in range(down):
                    for dx in range(int(attrs.get("colspan", 1))):
                        if y + dy < len(self.rows):
                            places.setdefault((y + dy, x + dx), text.strip())
        return [[places.get((y, x), "") for x in range(max((i for j, i in places if j == y), default=-1) + 1)] for y in range(len(self.rows))]


@pytest.mark.parametrize(
    "source",
    [
        BOTH,
        "<table><tr><td colspan=2>a</td><td>b</td></tr><tr><td rowspan=0>c</td><td>d</td><td>e</td></tr><tr><td>f</td><td>g</td></tr></table>",
        "<table><tr><td rowspan=9>a</td><td>b</td></tr><tr><td>c</td></tr><tr></tr></table>",
        "<table><tr><td>a</td><td rowspan=2>b</td><td>c</td></tr><tr><td colspan=3>d</td></tr></table>",
        "<table><tr><td>plain</td><td>cells</td></tr><tr><td>only</td><td>here</td></tr></table>",
    ],
)
def test_cells_stand_at_every_place_they_cover(spark, source):
    plain = Plain()
    plain.feed(source)
    expected = plain.grid()
    row = tables.with_rows(spark.createDataFrame([(source,)], "source string")).first()
    assert [row["header"], *row["body"]] == [r for i, r in enumerate(expected) if r or not i]


def test_values_meet_their_headers(spark):
    found = tables.table_cells(spark.createDataFrame([(1, BOTH)], "id int, source string"), ["id"]).collect()
    cells = {(r.row_idx, r.col_idx): (r.header, r.value) for r in found}
    assert cells[0, 0] == ("Name", "Name") and cells[0, 2] == ("Marks", "Second")
    assert cells[1, 1] == cells[2, 1] == ("Marks", "10") and cells[2, 2] == ("Marks", "30") and cells[3, 2] == ("Marks", "none")


def test_tables_without_spans(spark):
    df = spark.createDataFrame([("<table><tr><td>a</td></tr></table>",)], "source string")
    assert tables.with_rows(df).first()["header"] == ["a"]


def test_unreadable_spans(spark):
    source = "<table><tr><td colspan=x>a</td><td rowspan=>b</td></tr><tr></tr><tr><td rowspan=99999999999>c</td><td>d</td></tr></table>"
    row = tables.with_rows(spark.createDataFrame([(source,)], "source string")).first()
    assert [row["header"], *row["body"]] == [["a", "b"], ["c", "d"]]


def test_spans_in_section_records_need_no_python(spark):
    found = tables.table_row_maps(spark.createDataFrame([(1, BOTH)], "id int, source string"), ["id"])
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    assert found.filter("row_idx = 2").first()["cells"] == {"Name": "B", "Marks": "30"}
