"""Metrics of an extraction as one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.mapping import chapter_rules
from factloom.plans.skew import lookup


def beside(*rows: DataFrame) -> DataFrame:
    """Frames of one row and different columns as one row."""
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r, allowMissingColumns=True)
    return every.agg(*(F.max(c).alias(c) for c in every.columns))


def extraction_metrics(pages: DataFrame, refined: DataFrame, rows: DataFrame) -> DataFrame:
    """Pages, tables, rows and cells extracted, cells to map, and tables with each error."""
    seen = pages.agg(F.count(F.lit(1)).alias("resources_analysed"))
    tables = refined.agg(
        F.count(F.lit(1)).alias("tables_found"),
        F.count_if(F.col("status") == "E2").alias("no_header_tables"),
        F.count_if(F.col("status") == "E3").alias("data_errors"),
        F.coalesce(F.sum("headers_not_resolved"), F.lit(0)).cast("long").alias("unresolved_headers"),
    )
    filled = lambda cells: F.size(F.filter(cells, lambda c: ~c["empty"]))
    each = rows.select(F.explode("rows").alias("r"))
    values = F.size(F.filter(F.col("r.cells"), lambda c: c["value"] != "-"))
    data = each.agg(
        F.count(F.lit(1)).alias("rows_extracted"),
        F.coalesce(F.sum(filled(F.col("r.cells"))), F.lit(0)).cast("long").alias("cells_extracted"),
        F.coalesce(F.sum(filled(F.col("r.cells"))) - F.sum(F.when(F.col("r.removed"), values).otherwise(0)), F.lit(0)).cast("long").alias("cells_to_map"),
    )
    return beside(seen, tables, data)


def unmapped(rows: DataFrame, rules: DataFrame, chapter: str, fallback: str | None = None) -> DataFrame:
    """(unmapped_sections, unmapped_headers): counted once a table for each key without a property.

    All headers of a table count whose section has none.
    """
    own = chapter_rules(rules, chapter, fallback)
    by = lambda kind, name: own.where(F.col("kind").isin(kind, "any")).select(F.col("key").alias(f"{name}_key"), F.col("property").alias(name))
    first = F.filter("rows", lambda r: ~r["removed"])
    tables = rows.select("resource", "table_ord", "section", first.alias("rows"), F.concat(F.lit("SECTION_"), "section").alias("section_key"))
    tables = tables.join(by("section", "section_property").withColumnRenamed("section_property_key", "section_key"), "section_key", "left").withColumn("bare", F.coalesce("section_property", F.lit("")) == "")
    width = F.when(F.col("bare"), F.coalesce(F.size(F.get("rows", F.lit(0))["cells"]), F.lit(0))).otherwise(0)
    of_sections = tables.agg(F.count_if("bare").alias("unmapped_sections"), F.coalesce(F.sum(width), F.lit(0)).cast("long").alias("w"))
    cells = tables.where("not bare").select("resource", "table_ord", "section", F.explode("rows").alias("r")).select("resource", "table_ord", "section", F.explode("r.cells").alias("c")).where("c.value <> '-'")
    heads = cells.select("resource", "table_ord", "section", F.col("c.header").alias("loose_key")).distinct().withColumn("strict_key", F.concat_ws("_", "section", "loose_key"))
    apart = F.concat_ws("\0", "resource", "table_ord", "section")
    met = lookup(lookup(heads, by("strict", "strict"), "strict_key", apart), by("loose", "loose"), "loose_key", apart)
    chosen = F.when(F.col("strict").isNotNull(), F.col("strict")).otherwise(F.coalesce("loose", F.lit("")))
    of_headers = met.agg(F.count_if(chosen == "").alias("n"))
    return beside(of_sections, of_headers).select("unmapped_sections", (F.col("w") + F.col("n")).alias("unmapped_headers"))


def mapping_metrics(triples: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    """(row_triples, cell_triples, triples, graph_size): the graph, their set, counts a triple once."""
    counted = triples.agg(F.count_if(F.col("kind") == "row").alias("row_triples"), F.count_if(F.col("kind") == "cell").alias("cell_triples"), F.count(F.lit(1)).alias("triples"))
    size = (triples.select("s", "p", "o", "o_kind", "datatype").distinct() if graph is None else graph).agg(F.count(F.lit(1)).alias("graph_size"))
    return beside(counted, size)


def full_report(pages: DataFrame, refined: DataFrame, rows: DataFrame, rules: DataFrame, triples: DataFrame, chapter: str = "en", fallback: str | None = None, graph: DataFrame | None = None) -> DataFrame:
    """All metrics, and effectiveness: cell triples of cells to map, 0 if there are none, to 3 decimals."""
    every = beside(extraction_metrics(pages, refined, rows), unmapped(rows, rules, chapter, fallback), mapping_metrics(triples, graph))
    return every.withColumn("effectiveness", F.round(F.coalesce(F.try_divide(F.col("cell_triples"), F.col("cells_to_map")), F.lit(0.0)), 3))
