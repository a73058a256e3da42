"""Extraction over a stream of pages: the batch plan, batch by batch, with the row numbers of resources as state.

Parsing and refining keep no state. Rows of a resource are numbered on over
batches, so that pages of one resource may come at any time: each batch writes the
counts of the resources that it met beside its triples, under its number, and
reads those of the batches before. A batch that is run again after a failure
reads the same and overwrites its own output. As numbers go on, no two batches
give the same triple.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.mapping import Names, chapter_rules, graph, make_triples, row_counts
from factloom.operators.refine import refine
from factloom.operators.rows import table_rows
from factloom.plans.scratch import Scratch
from factloom.sources.pages import dealt, parse_tables

#: Batches after which all counts are written as one, so that those before it are read no more.
WHOLE = 50


def stream_tables(pages: DataFrame, mode: str = "compat") -> DataFrame:
    """Refined tables of a stream of pages, as a stream."""
    return refine(parse_tables(pages, mode))


def _counts(spark: SparkSession, folder: str, number: int, whole: int) -> DataFrame | None:
    """(resource, rows) after all batches before ``number``; None before the first."""
    if number == 0:
        return None
    start = (number - 1) // whole * whole  # the batch that wrote all counts last, or the first
    paths = [f"{folder}/batch={i}" for i in range(start, number)]
    return spark.read.schema("resource string, rows long").parquet(*paths).groupBy("resource").agg(F.max("rows").alias("rows"))


def start_extraction(
    pages: DataFrame,
    rules: DataFrame,
    path: str,
    checkpoint: str,
    chapter: str = "en",
    names: Names = Names(),
    kb: DataFrame | None = None,
    trigger: dict | None = None,
    each: Callable[[DataFrame, int], None] | None = None,
    mode: str = "compat",
    drop_summaries: bool = True,
    fallback: str | None = None,
    prefer_link: bool = False,
    whole: int = WHOLE,
) -> StreamingQuery:
    """Start writing the triples of a stream of pages to ``path``, one folder a batch, and the counts of rows to ``path`` and ``_rows``; what a batch keeps meanwhile goes with it."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        scratch = Scratch(spark, "batch")
        try:
            rows = scratch.save(table_rows(refine(parse_tables(dealt(batch), mode)), mode, drop_summaries), "rows")
            before = _counts(spark, f"{path}/_rows", number, whole)
            met = None if before is None else scratch.save(before.join(rows.select(F.coalesce("resource", F.concat(F.lit("page_"), F.col("page_id").cast("string"))).alias("resource")).distinct(), "resource", "left_semi"), "met")
            triples = graph(make_triples(rows, rules, chapter, kb, names, fallback, prefer_link, scratch, met))
            triples.write.mode("overwrite").parquet(f"{path}/batch={number}")
            counts = row_counts(rows, chapter_rules(rules, chapter, fallback), met)
            if number and number % whole == 0:
                counts = before.unionByName(counts).groupBy("resource").agg(F.max("rows").alias("rows"))
            counts.write.mode("overwrite").parquet(f"{path}/_rows/batch={number}")
        finally:
            scratch.close()
        if each is not None:
            each(batch, number)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
