"""Counts of page structures, inside the JVM, and their running total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.plans.scratch import Scratch
from factloom.plans.skew import salted_join
from factloom.sources.pages import with_status

#: Tags that open a table or a list item, in any case and with anything behind the name. Fixed values.
PATTERNS = {"table": r"(?i)<table(?=[\s/>])", "list": r"(?i)<li(?=[\s/>])"}
#: What holds no tags: comments, scripts, styles.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)(?=[\s/>]).*?(?:</\1\s*>|\z)"
#: Distinct pages of a range of the running total.
RANGE = 200_000


def opened(html: Column, kind: str) -> Column:
    """How many structures of a kind ``html`` opens."""
    return F.regexp_count(F.regexp_replace(html, _HIDDEN, " "), F.lit(PATTERNS[kind]))


def count_structures(pages: DataFrame, kind: str) -> DataFrame:
    """(page_id, n): structures of a kind in each page; pages without content count none and are ``lost``."""
    marked = with_status(pages)
    n = F.when(F.col("status") == "OK", opened(F.col("html"), kind)).otherwise(0)
    return marked.select("page_id", n.cast("long").alias("n"), (F.col("status") != "OK").alias("lost"))


def running_total(counts: DataFrame, size: int = RANGE) -> DataFrame:
    """(page_id, n, total): the total so far in the order of pages; pages of one id have one total, those without an id none.

    Ids are summed first, then cut into ranges of about equal numbers of ids,
    whose sums come before the totals within, so that no task sees all rows.
    """
    scratch = Scratch(counts.sparkSession, "totals")
    rows = scratch.save(counts.select("page_id", "n", F.monotonically_increasing_id().alias("place")), "counts")
    n = rows.count()
    ids = rows.where("page_id is not null").groupBy("page_id").agg(F.sum("n").alias("s"))
    cut = scratch.save(ids.repartitionByRange(n // size + 1, "page_id").withColumn("part", F.spark_partition_id()), "ranges")
    sums = cut.groupBy("part").agg(F.sum("s").alias("s"))
    before = sums.select("part", (F.sum("s").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("s")).alias("before"))
    within = F.sum("s").over(Window.partitionBy("part").orderBy("page_id"))
    found = cut.withColumn("within", within).join(before, "part").select("page_id", F.col("s").alias("n"), (F.col("within") + F.col("before")).alias("total"))
    if cut.count() == n:  # each id once: the ranges hold all that is asked
        return found
    return salted_join(rows, found.select("page_id", "total"), "page_id", F.col("place"), n, "left").select("page_id", "n", "total")


def totals(pages: DataFrame) -> DataFrame:
    """One row: pages, lost pages, tables and list items."""
    marked = with_status(pages)
    n = lambda kind: F.sum(F.when(F.col("status") == "OK", opened(F.col("html"), kind)).otherwise(0)).cast("long")
    return marked.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") != "OK").alias("lost"), n("table").alias("tables"), n("list").alias("lists"))


def lost_pages(pages: DataFrame) -> DataFrame:
    """(reason, n, calls): lost pages by the class of what came in their place, and the calls that they took.

    ``reason``: missing, empty, or the message up to a colon; ``calls``: the
    column ``tries`` of pages that were fetched, else one for each.
    """
    html = F.col("html")
    message = F.trim(F.regexp_extract(html, r"(Error[^:\r\n]*)", 1))
    reason = F.when(html.isNull(), "missing").when(F.trim(html) == "", "empty").otherwise(message)
    calls = F.sum("tries") if "tries" in pages.columns else F.count(F.lit(1))
    return with_status(pages).where("status <> 'OK'").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), calls.cast("long").alias("calls"))
