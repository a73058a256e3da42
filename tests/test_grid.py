"""Parsing and joining of single tables, without Spark."""

from __future__ import annotations

import pytest

from factloom.sources import grid
from factloom.sources.grid import NBSP, as_number, number_text, parse_page, tree


def one(html: str, title: str = "Foo Bar", **options) -> dict:
    (found,) = parse_page(html, title, **options)
    return found


def wiki(body: str, kind: str = "wikitable") -> str:
    return f'<table class="{kind}">{body}</table>'


def test_spans_in_header_rows():
    t = one(wiki('<tr><th rowspan="2">Year</th><th colspan="2">Stats</th></tr><tr><th>G</th><th>PTS</th></tr>'))
    assert t["header_grid"] == [["Year", "Stats", "Stats"], ["", "G", "PTS"]]


def test_headers_beside_data():
    t = one(wiki("<tr><th>K1</th><td>v1</td></tr><tr><th>K2</th><td>v2</td></tr>"))
    assert t["vertical"] and t["header_grid"] == [["K1"], ["K2"]]
    data = [[c["td"] for c in r] for r in t["data_raw"]]
    assert data == [["K1", "v1"], ["K2", "v2"]]


def test_links_and_text():
    t = one(wiki('<tr><th>T</th></tr><tr><td><a title="Los Angeles Lakers">L.A. Lakers</a></td><td><a class="new">Red</a></td><td><a class="new"></a></td></tr>'))
    first, second, third = t["data_raw"][0]
    assert (first["links"], first["td"]) == (["Los Angeles Lakers"], "L.A. Lakers")
    assert second["links"] == ["Red"] and third == {"links": [], "td": "-", "number": None, "colspan": 1}


def test_header_quotes_become_points():
    assert one(wiki("<tr><th>it's?\nx</th></tr>"))["header_grid"] == [["it.s? x"]]


def test_newlines_in_cells():
    t = one(wiki(f"<tr><th>A</th></tr><tr><td>a\nb</td><td>12\n</td><td>\n 7</td><td>x{NBSP}y</td><td>\n</td></tr>"))
    assert [c["td"] for c in t["data_raw"][0]] == ["a/b", "12", "7", "x y", "-"]


def test_sections():
    html = '<h2><span id="a">Play-offs!</span></h2>' + wiki("<tr><th>A</th></tr>")
    assert one(html)["section"] == "Playoffs"
    assert one("<div>" + wiki("<tr><th>A</th></tr>") + "</div>", "Foo Bar")["section"] == "Foo Bar"
    assert one('<h3>no id</h3><h2><b></b><i id="x"><u>In</u>ner</i></h2><h4></h4>' + wiki("<tr><th>A</th></tr>"))["section"] == "In"


def test_tables_are_numbered_by_class():
    html = "".join(wiki(f"<tr><th>{i}</th></tr>", k) for i, k in enumerate(["wikitable sortable", "wikitable", "infobox", "wikitable plainrowheaders"]))
    assert [t["header_grid"][0][0] for t in parse_page(html, "x")] == ["1", "0"]
    assert [t["header_grid"][0][0] for t in parse_page(html, "x", "clean")] == ["0", "1", "3"]


def test_row_groups_and_open_tags():
    t = one(wiki("<caption>c</caption><thead><tr><th>A<th>B<tbody><tr><td>1<td>2<tr><td>3<td>4"))
    assert t["n_rows"] == 4 and t["header_grid"] == [["A", "B"]]
    assert [[c["td"] for c in r] for r in t["data_raw"]] == [["1", "2"], ["3", "4"]]


def test_colspan_is_kept_for_text_only():
    t = one(wiki('<tr><td colspan="2">note</td><td colspan="3"></td><td colspan="x">y</td></tr>'))
    assert [c["colspan"] for c in t["data_raw"][0]] == [2, 1, 1]


def test_deep_and_broken_html():
    assert tree("<div>" * 5000 + "x").text() == "x"
    assert parse_page("", "x") == parse_page("</table><td>", "x") == []
    assert parse_page('<table class="wikitable">', "x")[0]["header_grid"] == []
    assert one(wiki("<tr><td>a" + wiki("<tr><th>in") + "</td></tr>", "other"))["header_grid"] == [["in"]]


@pytest.mark.parametrize(("text", "number"), [("20", 20.0), (" 12 ", 12.0), ("1,000", None), ("1_000", None), ("1.0f", None), ("1e5", 1e5), ("", None), ("inf", float("inf"))])
def test_numbers(text, number):
    assert as_number(text) == number


@pytest.mark.parametrize(("x", "text"), [(20.0, "20.0"), (0.1 + 0.2, "0.3"), (1e16, "1e+16"), (1234567890123.0, "1.23456789012e+12"), (float("inf"), "inf"), (float("nan"), "nan"), (-0.5, "-0.5")])
def test_number_text(x, text):
    assert number_text(x) == text


def test_spans_without_bounds():
    from factloom.sources import grid

    html = '<table class="wikitable"><tr><th colspan="5000">A</th><th rowspan="100000">B</th></tr><tr><td colspan="2">x</td></tr></table>'
    (found,) = grid.parse_page(html, "t")
    (row,) = found["headers_raw"]
    assert [(h["colspan"], h["rowspan"]) for h in row] == [(grid.WIDEST, 1), (1, 100_000)]
    assert len(found["header_grid"][0]) == grid.WIDEST + 1


def shown(t):
    return t["header_grid"], [[c["td"] for c in r] for r in t["data_raw"]]


def test_places_that_spans_hold():
    """Cells that reach into rows below and over columns, in headers and data; none takes a place that another holds."""
    head = '<tr><th rowspan="2">Year</th><th colspan="2" rowspan="2">Both</th><th>Top</th></tr><tr><th>Low</th></tr>'
    body = '<tr><td rowspan="3">1999</td><td>a</td><td rowspan="2">b</td><td>c</td></tr><tr><td>d</td><td>e</td></tr><tr><td colspan="3">f</td></tr><tr><td>2000</td></tr>'
    header, data = shown(one(wiki(head + body), mode="clean"))
    assert header == [["Year", "Both", "Both", "Top"], ["", "", "", "Low"]]
    assert data == [["1999", "a", "b", "c"], ["1999", "d", "b", "e"], ["1999", "f", "f", "f"], ["2000"]]
    assert shown(one(wiki(head + body)))[1][1] == ["d", "e"]


def test_spans_that_overlap():
    body = '<tr><th>A</th><th>B</th><th>C</th><th>D</th></tr><tr><td>1</td><td>2</td><td rowspan="2">x</td></tr><tr><td colspan="3">wide</td><td>9</td></tr>'
    assert shown(one(wiki(body), mode="clean"))[1] == [["1", "2", "x"], ["wide", "wide", "x", "9"]]
    gap = '<tr><th>A</th><th>B</th><th>C</th></tr><tr><td>1</td><td>2</td><td rowspan="9">x</td></tr><tr><td></td></tr>'
    assert shown(one(wiki(gap), mode="clean"))[1] == [["1", "2", "x"], ["-", "-", "x"]]


def test_spans_beyond_all_bounds_in_clean_mode():
    """A table of long and wide cells is as wide as its headers at most."""
    body = "<tr><th>A</th><th>B</th></tr>" + '<tr><td rowspan="99999999" colspan="1000">x</td></tr>' * 300
    _, data = shown(one(wiki(body), mode="clean"))
    assert len(data) == 300 and data[-1] == ["x", "x"]


def test_headers_in_the_middle_of_data_are_none():
    body = "<tr><th>A</th></tr><tr><td>1</td></tr><tr><th>B</th></tr><tr><td>2</td></tr>"
    assert shown(one(wiki(body), mode="clean")) == shown(one(wiki(body))) == ([["A"]], [["1"], ["2"]])
    beside = "<tr><th>K1</th><td>v1</td></tr><tr><th>K2</th><td>v2</td></tr>"
    assert shown(one(wiki(beside), mode="clean")) == ([["K1"], ["K2"]], [["K1", "v1"], ["K2", "v2"]])


@pytest.mark.parametrize(
    "page",
    [
        '<table class="wikitable"><tr><td colspan="2" colspan="3">a<td>b</table>',
        '<p>x<p>y<h2><span id="s">A &amp; b</span></h2><ul><li>1<li>2</ul><br/><b><i>z</b></i></p>',
        "<tr><td>&nbsp;5 > 3\n</td></br><div/>&lt</table>",
        '<a href="/x" title="A b">c</a><td></td ><TD>',
        "<td class='x'>a</td><!-- <td> --><td a>",
        "<script>var t = '<table>';</script>a < b <",
    ],
)
def test_plain_pages_are_cut_as_the_parser_does(page):
    def listed(node):
        return node.tag, node.attrs, [x if isinstance(x, str) else listed(x) for x in node.items]

    builder = grid._Builder()
    builder.feed(page)
    builder.close()
    found = grid._plain_tree(page)
    assert (found is None) == any(x in page for x in ("<TD>", "<!--", "<script>"))
    assert listed(grid.tree(page)) == listed(builder.root)
