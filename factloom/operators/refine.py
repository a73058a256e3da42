"""Header and cell refinement as column expressions over the parsed grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import ascii_dots, once, strip_citations, strip_nbsp, to_float, underscored

#: The text that marks a total in a row. Fixed value.
TOTAL = "Totale"


def expand_colspan(row: Column, span: str = "colspan") -> Column:
    """A row of structs with each repeated as often as its span says."""
    return F.flatten(F.transform(row, lambda c: F.array_repeat(c, F.greatest(c[span], F.lit(1)))))


def clean_header(text: Column) -> Column:
    return strip_citations(strip_nbsp(text))


def merged_headers(grid: Column) -> Column:
    """Header rows as one: ``upper - lower``, or the one that has text. Null where rows differ in length."""
    even = F.forall(grid, lambda row: F.size(row) == F.size(F.get(grid, F.lit(0))))
    both = lambda up, low: F.when((up != "") & (low != ""), F.concat(up, F.lit(" - "), low)).when(low != "", low).otherwise(up)
    folded = F.aggregate(F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))), F.get(grid, F.lit(0)), lambda acc, row: F.zip_with(acc, row, both))
    return F.when((F.size(grid) > 0) & even, folded)


def refine(tables: DataFrame, tag: str = TOTAL) -> DataFrame:
    """Parsed tables with ``headers`` (to join data), ``headers_refined`` (to explore), ``data`` and ``status``.

    status: E2 without headers, E3 where headers can't be merged or no data is
    left, else OK. Of a table with headers beside its data the first cells are
    the refined headers, and the first row joins the data.
    """
    grid = F.transform("header_grid", lambda row: F.transform(row, clean_header))
    first = F.transform("grid", lambda row: ascii_dots(F.coalesce(F.get(row, F.lit(0)), F.lit(""))))
    row = F.get("grid", F.lit(0))
    beside = F.transform(row, lambda t, i: F.when(i == 0, ascii_dots(t)).otherwise(t))
    above = F.transform(merged_headers(F.col("grid")), ascii_dots)
    kept = F.filter("data_raw", lambda r: ~F.exists(r, lambda c: F.coalesce(c["td"] == tag, F.lit(False))))
    typed_cell = lambda c, num: F.struct(
        F.transform(c["links"], underscored).alias("links"),
        F.when(num.isNull(), c["td"]).alias("text"),
        num.alias("num"),
        c["number"].alias("shown"),
    )
    # only what the parser shows as a number can be one, and is read once
    cell = lambda c: F.when(c["number"].isNull(), typed_cell(c, F.lit(None).cast("double"))).otherwise(once(to_float(c["td"]), lambda num: typed_cell(c, num)))
    wide = lambda r: F.when(F.exists(r, lambda c: c["colspan"] > 1), expand_colspan(r)).otherwise(r)
    typed = F.transform(kept, lambda r: F.transform(wide(r), cell))
    # the status asks the parsed grids: a filter on it would compute headers and data a second time
    uneven = ~F.col("vertical") & ~F.forall("header_grid", lambda row: F.size(row) == F.size(F.get("header_grid", F.lit(0))))
    no_data = ~F.exists("data_raw", lambda r: (F.size(r) > 0) & ~F.exists(r, lambda c: F.coalesce(c["td"] == tag, F.lit(False))))
    return (
        tables.withColumn("grid", grid)
        .withColumn("headers", F.when(F.col("vertical"), beside).otherwise(above))
        .withColumn("headers_refined", F.when(F.col("vertical"), first).otherwise(F.col("headers")))
        .withColumn("data", F.filter(typed, lambda r: F.size(r) > 0))
        .withColumn("status", F.when(F.size("header_grid") == 0, "E2").when(uneven | no_data, "E3").otherwise("OK"))
        .drop("grid")
    )
