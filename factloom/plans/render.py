"""Rows into pages with data tables: the inverse of the parser, for tests, queries and the bench."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.grid import TABLE_CLASSES


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def tags(name: str, *cells: Column) -> Column:
    return F.concat(*[F.concat(F.lit(f"<{name}>"), F.coalesce(c, F.lit("")), F.lit(f"</{name}>")) for c in cells])


def row_html(*cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), tags("td", *cells), F.lit("</tr>"))


def table_html(rows: Column, head: str, section: Column, kind: str = TABLE_CLASSES[0]) -> Column:
    """A heading and the table below it; ``rows``: its data rows as HTML."""
    return F.concat(F.lit('<h2><span id="s">'), escaped(section), F.lit(f'</span></h2><table class="{kind}">{head}'), rows, F.lit("</table>"))


def head_html(*names: str) -> str:
    return "<tr>" + "".join(f"<th>{x}</th>" for x in names) + "</tr>"


def collected(rows: DataFrame, keys: list[str], order: str, html: str = "row") -> DataFrame:
    """``keys`` and ``rows``: the HTML of a group's rows in order."""
    own = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, html))).alias("x"))
    return own.select(*keys, F.array_join(F.col(f"x.{html}"), "").alias("rows"))
