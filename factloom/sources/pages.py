"""Scans: resource lists, pages, and the tables in pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.functions.text import strip_punctuation
from factloom.plans.arrow import giving_back, no_cycles, slices
from factloom.plans.skew import spread
from factloom.sources.grid import TABLE_CLASSES, parse_page

HEADER = T.StructType([T.StructField("th", T.StringType()), T.StructField("colspan", T.IntegerType()), T.StructField("rowspan", T.IntegerType())])
CELL = T.StructType([T.StructField("links", T.ArrayType(T.StringType())), T.StructField("td", T.StringType()), T.StructField("number", T.StringType()), T.StructField("colspan", T.IntegerType())])
TABLES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("resource", T.StringType()),
        T.StructField("table_ord", T.IntegerType()),
        T.StructField("section", T.StringType()),
        T.StructField("vertical", T.BooleanType()),
        T.StructField("n_rows", T.IntegerType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("headers_raw", T.ArrayType(T.ArrayType(HEADER))),
        T.StructField("header_grid", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("data_raw", T.ArrayType(T.ArrayType(CELL))),
        T.StructField("headers_not_resolved", T.IntegerType()),
    ]
)

#: Bytes of pages that are parsed at once; as Python's objects they are many times that.
PARSED_BYTES = 1 << 20


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    """(resource_ord, resource) of a text file with a name on each line; a blank last line is none."""
    lines = spark.read.text(path).where("value <> ''")
    return lines.select(F.monotonically_increasing_id().alias("resource_ord"), F.col("value").alias("resource"))


def one_resource(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([(0, name)], "resource_ord long, resource string")


def with_status(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Pages with ``status``: OK, or LOST for a page without content or with an error in its place."""
    html = F.col(html_col)
    lost = html.isNull() | (F.trim(html) == "") | (~html.contains("<") & html.contains("Error"))
    return pages.withColumn("status", F.when(lost, "LOST").otherwise("OK"))


def dealt(pages: DataFrame) -> DataFrame:
    """Pages (page_id, resource, html) over all tasks, as many pages, and much work, may be few bytes of one file. What ``parse_tables`` drops is dropped before."""
    return spread(pages, "page_id", "resource", "html")


def parse_tables(pages: DataFrame, mode: str = "compat", data: bool = True) -> DataFrame:
    """The data tables of pages (page_id, resource, html), one row each, as ``TABLES``.

    Pages that can't hold one are dropped by the scan, before any Python runs.
    ``data`` False reads headers and sections only. Lost and null pages have no
    tables. The page's title is its resource, unaccented names being the scan's duty.
    """
    title = strip_punctuation(F.replace(F.coalesce("resource", F.lit("")), F.lit("_"), F.lit(" ")))
    fitting = pages.where(F.col("html").rlike("(?i)<table") & F.col("html").contains(TABLE_CLASSES[0]))
    asked = fitting.select(F.col("page_id").cast("long"), "resource", title.alias("title"), "html")
    target = to_arrow_schema(TABLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, PARSED_BYTES):
                with no_cycles():
                    rows = [
                        {"page_id": page, "resource": resource, **table, "attrs": list(table["attrs"].items())}
                        for page, resource, name, html in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                        for table in parse_page(html, name or "", mode, data)
                    ]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=target)

    return asked.mapInArrow(giving_back(run), TABLES)
