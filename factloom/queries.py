"""The registered queries over the relational tables, and their SQL.

The tables hold no page with a data table, so the queries render rows into
pages, run the engine over these, and the SQL computes the same from the rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom import run
from factloom.functions import text as fn
from factloom.operators import explore, kb, mapping, rules, stats
from factloom.operators.refine import refine
from factloom.operators.rows import table_rows
from factloom.plans.render import collected, escaped, head_html, row_html, table_html, tags
from factloom.plans.scratch import Scratch
from factloom.plans.skew import spread
from factloom.sources import answers, sinks
from factloom.sources.pages import dealt, one_resource, parse_tables, read_resources, with_status
from factloom.sources.sinks import ntriples_lines, turtle_blocks
from factloom.sources.triples import read_triples

BASE, ONTOLOGY = "http://kb.example.org/resource/", "http://kb.example.org/ontology/"
FLOAT, STRING = mapping.XSD + "float", mapping.XSD + "string"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query, with the SQL of its result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rule_frame(spark: SparkSession, *given: tuple[str, str, str], chapter: str = "en") -> DataFrame:
    """Rules of (kind, key, property)."""
    return spark.createDataFrame([(chapter, k, None, None, key, p) for k, key, p in given], rules.RULES)


def region_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their region."""
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def nation_pages(spark: SparkSession, sf_dir: str, last: str = "", extra: str = "") -> DataFrame:
    """A page for each region with a table of its nations; ``last``: HTML behind the rows, ``extra``: before the table."""
    rows = region_nations(spark, sf_dir).select("r_regionkey", "r_name", "n_nationkey", row_html(escaped(F.col("n_name")), F.col("n_nationkey").cast("string"), escaped(F.col("r_name"))).alias("row"))
    pages = collected(rows, ["r_regionkey", "r_name"], "n_nationkey")
    html = F.concat(F.lit(f"<html><body>{extra}"), table_html(F.concat("rows", F.lit(last)), head_html("Nation", "Key", "Region"), F.lit("Nations")), F.lit("</body></html>"))
    return pages.select(F.col("r_regionkey").cast("long").alias("page_id"), F.replace("r_name", F.lit(" "), F.lit("_")).alias("resource"), html.alias("html"))


NATION_RULES = (("section", "SECTION_Nations", "nation"), ("loose", "Nation", "name"), ("loose", "Key", "number"), ("strict", "Nations_Region", "partOf"))


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer with a table of their orders."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", row_html(F.concat(F.lit("No "), F.col("o_orderkey").cast("string")), F.col("o_orderstatus"), F.col("o_totalprice").cast("string"), F.col("o_orderpriority")).alias("row"))
    pages = collected(rows, ["o_custkey"], "o_orderkey")
    html = F.concat(F.lit("<html><body><p>Orders<p>"), table_html(F.col("rows"), head_html("Order", "Status", "Total", "Priority"), F.lit("Orders"), "wikitable sortable"), F.lit("</body></html>"))
    return pages.select(F.col("o_custkey").alias("page_id"), F.concat(F.lit("Customer_"), F.col("o_custkey").cast("string")).alias("resource"), html.alias("html"))


ORDER_RULES = (("section", "SECTION_Orders", "order"), ("loose", "Order", "label"), ("loose", "Status", "status"), ("strict", "Orders_Total", "total"), ("loose", "Priority", "priority"))


def parsed(pages: DataFrame, mode: str = "compat", data: bool = True) -> DataFrame:
    """Pages to refined tables, by all tasks."""
    return refine(parse_tables(dealt(pages), mode, data))


def joined(pages: DataFrame, mode: str = "compat") -> DataFrame:
    """Pages to joined rows."""
    return table_rows(parsed(pages, mode), mode)


def long_cells(rows: DataFrame) -> DataFrame:
    """(page_id, row_ord, removed, cell): a row for each cell.

    Of a plain explode Spark infers that rows are not empty, and asks this of the expression that makes them, once more before they are made.
    """
    each = rows.select("page_id", F.explode_outer("rows").alias("r")).where("r is not null")
    return each.select("page_id", F.col("r.row_ord").alias("row_ord"), F.col("r.removed").alias("removed"), F.explode("r.cells").alias("cell"))


# ---------------------------------------------------------------- tables and headers


@query("""
SELECT CAST(r_regionkey AS BIGINT) AS page_id, t.table_ord, t.section, CAST(CASE WHEN t.table_ord = 0 THEN n + 1 ELSE 2 END AS INTEGER) AS n_rows, t.n_headers, false AS vertical
FROM (SELECT r_regionkey, r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL),
     LATERAL (VALUES (0, 'Nations', 3), (1, r_name, 1)) t(table_ord, section, n_headers)
""")
def table_scan_sections(spark, sf_dir):
    """Tables numbered by class before place, sections from headings or the page's name."""
    extra = '<hr><table class="wikitable sortable"><thead><tr><th>Only</th></tr></thead><tbody><tr><td>x</td></tr></tbody></table><table class="infobox"><tr><th>no</th></tr></table>'
    found = parsed(nation_pages(spark, sf_dir, extra=extra))
    return found.select("page_id", "table_ord", "section", "n_rows", F.size("headers_refined").alias("n_headers"), "vertical")


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS page_id, h.header_ord, CASE WHEN h.header_ord = 0 THEN n_name ELSE n_name || ' account - ' || h.name END AS header
FROM nation, (VALUES (0, ''), (1, 'Balance'), (2, 'Segment')) h(header_ord, name)
""")
def header_colspan_merge(spark, sf_dir):
    """Two header rows with row and column spans as one."""
    name = escaped(F.col("n_name"))
    head = F.concat(F.lit('<tr><th rowspan="2">'), name, F.lit('</th><th colspan="2">'), name, F.lit(" account</th></tr><tr><th>Balance</th><th>Segment</th></tr>"))
    html = F.concat(F.lit('<table class="wikitable">'), head, F.lit("<tr><td>1</td><td>2</td><td>3</td></tr></table>"))
    pages = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), F.col("n_name").alias("resource"), html.alias("html"))
    return parsed(pages).select("page_id", F.posexplode("headers_refined").alias("header_ord", "header"))


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS page_id, n_name || ' Citt. it.s. ' AS header FROM nation
""")
def header_citation_ascii(spark, sf_dir):
    """Headers without citations, in ASCII with points."""
    html = F.concat(F.lit('<table class="wikitable"><tr><th>'), escaped(F.col("n_name")), F.lit(" Città it's? ["), F.col("n_nationkey").cast("string"), F.lit("]</th></tr><tr><td>1</td></tr></table>"))
    pages = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), F.col("n_name").alias("resource"), html.alias("html"))
    return parsed(pages).select("page_id", F.explode("headers").alias("header"))


# ---------------------------------------------------------------- cells

_NATION_CELLS = """
  SELECT CAST(n_regionkey AS BIGINT) AS page_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS row_ord,
         n_name, n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
"""


@query(f"""
WITH n AS ({_NATION_CELLS})
SELECT page_id, row_ord, 'Nation' AS header, n_name AS value FROM n
UNION ALL SELECT page_id, row_ord, 'Key', CAST(n_nationkey AS VARCHAR) || '.0' FROM n
UNION ALL SELECT page_id, row_ord, 'Region', r_name FROM n
""")
def cells_long(spark, sf_dir):
    """Cells of data rows under their headers."""
    return long_cells(joined(nation_pages(spark, sf_dir))).select("page_id", "row_ord", F.col("cell.header").alias("header"), F.col("cell.value").alias("value"))


@query("""
SELECT CAST(o_custkey AS BIGINT) AS page_id, count(*) AS n_cells, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1
""")
def numeric_typing(spark, sf_dir):
    """Texts that read as numbers are numbers."""
    found = parsed(order_pages(spark, sf_dir))
    numbers = found.select("page_id", F.explode(F.flatten("data")).alias("c")).where("c.num is not null")
    return numbers.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_cells"), F.sum(F.round(F.col("c.num") * 100).cast("long")).alias("cents"))


@query("""
SELECT CAST(n_regionkey AS BIGINT) AS page_id, count(*) AS n_rows, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation GROUP BY 1
""")
def totale_filter(spark, sf_dir):
    """Rows marked as a total are no data."""
    found = parsed(nation_pages(spark, sf_dir, last="<tr><td>Totale</td><td>999</td><td>-</td></tr>"))
    rows = found.select("page_id", F.explode("data").alias("r"))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.get("r", F.lit(1))["num"].cast("long")).alias("keys"))


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS page_id, t.row_ord, t.header, CASE t.k WHEN 'n' THEN n_name WHEN 'k' THEN CAST(n_nationkey AS VARCHAR) || '.0' ELSE t.k END AS value
FROM nation, (VALUES (0, 'A', 'n'), (0, 'B', 'k'), (1, 'A', 'y'), (1, 'B', 'k'), (2, 'A', 'y'), (2, 'B', 'k'), (3, 'A', 'end')) t(row_ord, header, k)
""")
def ragged_rows(spark, sf_dir):
    """Long rows go on as rows, short ones are filled by the next."""
    name, key = escaped(F.col("n_name")), F.col("n_nationkey").cast("string")
    html = F.concat(F.lit('<table class="wikitable"><tr><th>A</th><th>B</th></tr>'), row_html(name, key), row_html(F.lit("s")), row_html(F.lit("y"), key, F.lit("end")), F.lit("</table>"))
    pages = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), F.col("n_name").alias("resource"), html.alias("html"))
    return long_cells(joined(pages)).select("page_id", "row_ord", F.col("cell.header").alias("header"), F.col("cell.value").alias("value"))


@query(f"""
WITH n AS ({_NATION_CELLS})
SELECT page_id, row_ord, n_name AS nation FROM n
""")
def clean_rows(spark, sf_dir):
    """Clean mode: any table of the class, surplus cells cut, short rows short."""
    rows = region_nations(spark, sf_dir).select("r_regionkey", "r_name", "n_nationkey", row_html(escaped(F.col("n_name")), F.col("n_nationkey").cast("string"), F.lit("surplus")).alias("row"))
    html = table_html(F.col("rows"), head_html("Nation", "Key"), F.lit("Nations"), "plain wikitable")
    pages = collected(rows, ["r_regionkey", "r_name"], "n_nationkey").select(F.col("r_regionkey").cast("long").alias("page_id"), F.col("r_name").alias("resource"), html.alias("html"))
    return long_cells(joined(pages, "clean")).where("cell.header = 'Nation'").select("page_id", "row_ord", F.col("cell.value").alias("nation"))


def spanned_pages(spark, sf_dir):
    """A page for each customer: orders by status, the status a cell over all its rows, the total a cell over two columns, below headers of two rows."""
    o = table(spark, sf_dir, "orders")
    each = Window.partitionBy("o_custkey", "o_orderstatus")
    o = o.withColumn("k", F.row_number().over(each.orderBy("o_orderkey"))).withColumn("n", F.count(F.lit(1)).over(each))
    status = F.when(F.col("k") == 1, F.concat(F.lit('<td rowspan="'), F.col("n").cast("string"), F.lit('">'), "o_orderstatus", F.lit("</td>"))).otherwise("")
    row = F.concat(F.lit("<tr>"), status, F.lit("<td>No "), F.col("o_orderkey").cast("string"), F.lit('</td><td colspan="2">'), F.col("o_totalprice").cast("string"), F.lit("</td></tr>"))
    head = '<tr><th rowspan="2">Status</th><th colspan="3">Order</th></tr><tr><th>No</th><th>Total</th><th>Again</th></tr>'
    pages = collected(o.select("o_custkey", F.struct("o_orderstatus", "o_orderkey").alias("place"), row.alias("row")), ["o_custkey"], "place")
    html = table_html(F.col("rows"), head, F.lit("Orders"), "wikitable plainrowheaders")
    return pages.select(F.col("o_custkey").alias("page_id"), F.concat(F.lit("Customer_"), F.col("o_custkey").cast("string")).alias("resource"), html.alias("html"))


_SPANNED = "SELECT o_custkey AS page_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS i, * FROM orders"


@query(f"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS row_ord, h.header, CASE h.k WHEN 0 THEN o_orderstatus WHEN 1 THEN 'No ' || o_orderkey ELSE CAST(o_totalprice AS VARCHAR) END AS value
FROM ({_SPANNED}), (VALUES (0, 'Status'), (1, 'Order - No'), (2, 'Order - Total'), (2, 'Order - Again')) h(k, header)
""")
def clean_spans(spark, sf_dir):
    """Clean mode: cells over rows and columns are cells of each place that they hold."""
    return long_cells(joined(spanned_pages(spark, sf_dir), "clean")).select("page_id", "row_ord", F.col("cell.header").alias("header"), F.col("cell.value").alias("value"))


@query(f"""
WITH o AS (SELECT *, '{BASE}Customer_' || o_custkey || '__' || i AS row_iri FROM ({_SPANNED}))
SELECT '{BASE}Customer_' || o_custkey AS s, '{ONTOLOGY}order' AS p, row_iri AS o, 'iri' AS o_kind, NULL AS datatype FROM o
UNION ALL SELECT row_iri, '{ONTOLOGY}status', o_orderstatus, 'literal', '{STRING}' FROM o
UNION ALL SELECT row_iri, '{ONTOLOGY}label', 'No ' || o_orderkey, 'literal', '{STRING}' FROM o
UNION ALL SELECT row_iri, '{ONTOLOGY}total', CAST(o_totalprice AS VARCHAR), 'literal', '{FLOAT}' FROM o
""")
def clean_triples(spark, sf_dir):
    """The graph of these pages."""
    given = (("section", "SECTION_Orders", "order"), ("loose", "Status", "status"), ("loose", "Order - No", "label"), ("strict", "Orders_Order - Total", "total"))
    return mapping.graph(mapping.make_triples(table_rows(parsed(spanned_pages(spark, sf_dir), "clean"), "clean", drop_summaries=False), rule_frame(spark, *given)))


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS page_id, n_name AS value, replace(n_name || ' (country)', ' ', '_') AS link FROM nation
""")
def link_titles(spark, sf_dir):
    """Anchors give a title as link; the value is the text."""
    link = F.concat(F.lit('<a href="/x" title="'), escaped(F.col("n_name")), F.lit(' (country)">'), escaped(F.col("n_name")), F.lit("</a>"))
    html = F.concat(F.lit('<table class="wikitable"><tr><th>Nation</th></tr>'), row_html(link), F.lit("</table>"))
    pages = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), F.col("n_name").alias("resource"), html.alias("html"))
    return long_cells(joined(pages)).select("page_id", F.col("cell.value").alias("value"), F.get("cell.links", F.lit(0)).alias("link"))


@query("""
SELECT CAST(n_regionkey AS BIGINT) AS page_id, count(*) AS kept, CAST(1 AS BIGINT) AS removed FROM nation GROUP BY 1
""")
def summary_row_removed(spark, sf_dir):
    """A row with the sums of the rows above it is no data."""
    rows = region_nations(spark, sf_dir)
    each = rows.select("r_regionkey", "r_name", "n_nationkey", row_html(escaped(F.col("n_name")), (F.col("n_nationkey") + 7).cast("string"), (F.col("n_nationkey") * 2 + 31).cast("string")).alias("row"))
    sums = rows.groupBy("r_regionkey").agg(F.sum(F.col("n_nationkey") + 7).alias("a"), F.sum(F.col("n_nationkey") * 2 + 31).alias("b"))
    pages = collected(each, ["r_regionkey", "r_name"], "n_nationkey").join(sums, "r_regionkey")
    html = table_html(F.concat("rows", row_html(F.lit("Grand total of them"), F.col("a").cast("string"), F.col("b").cast("string"))), head_html("Nation", "Key", "Odd"), F.lit("Nations"))
    pages = pages.select(F.col("r_regionkey").cast("long").alias("page_id"), F.col("r_name").alias("resource"), html.alias("html"))
    found = joined(pages).select("page_id", F.explode("rows").alias("r"))
    return found.groupBy("page_id").agg(F.count_if(~F.col("r.removed")).alias("kept"), F.count_if("r.removed").alias("removed"))


# ---------------------------------------------------------------- triples

_NATION_ROWS = f"""
WITH n AS ({_NATION_CELLS}), r AS (
  SELECT '{BASE}' || replace(r_name, ' ', '_') AS subject, '{BASE}' || replace(r_name, ' ', '_') || '__' || (row_ord + 1) AS row_iri, * FROM n
)
"""
_NATION_TRIPLES = f"""
SELECT subject AS s, '{ONTOLOGY}nation' AS p, row_iri AS o, 'iri' AS o_kind, NULL AS datatype FROM r
UNION ALL SELECT row_iri, '{ONTOLOGY}name', n_name, 'literal', '{STRING}' FROM r
UNION ALL SELECT row_iri, '{ONTOLOGY}number', n_nationkey || '.0', 'literal', '{FLOAT}' FROM r
UNION ALL SELECT row_iri, '{ONTOLOGY}partOf', r_name, 'literal', '{STRING}' FROM r
"""


def nation_triples(spark, sf_dir):
    return mapping.make_triples(joined(nation_pages(spark, sf_dir)), rule_frame(spark, *NATION_RULES))


@query(_NATION_ROWS + _NATION_TRIPLES)
def triples(spark, sf_dir):
    """The graph of the nation pages."""
    return mapping.graph(nation_triples(spark, sf_dir))


@query(_NATION_ROWS + f"SELECT subject AS s, '{ONTOLOGY}nation' AS p, row_iri AS o FROM r")
def row_triples(spark, sf_dir):
    return nation_triples(spark, sf_dir).where("kind = 'row'").select("s", "p", "o")


@query(_NATION_ROWS + f"SELECT row_iri AS s, '{ONTOLOGY}number' AS p, n_nationkey || '.0' AS o, '{FLOAT}' AS datatype FROM r")
def cell_triples(spark, sf_dir):
    return nation_triples(spark, sf_dir).where(f"kind = 'cell' and p = '{ONTOLOGY}number'").select("s", "p", "o", "datatype")


_ORDER_TRIPLES = f"""
WITH o AS (
  SELECT *, '{BASE}Customer_' || o_custkey AS subject, '{BASE}Customer_' || o_custkey || '__' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_iri FROM orders
)
SELECT subject AS s, '{ONTOLOGY}order' AS p, row_iri AS o, 'iri' AS o_kind, NULL AS datatype FROM o
UNION ALL SELECT row_iri, '{ONTOLOGY}label', 'No ' || o_orderkey, 'literal', '{STRING}' FROM o
UNION ALL SELECT row_iri, '{ONTOLOGY}status', o_orderstatus, 'literal', '{STRING}' FROM o
UNION ALL SELECT row_iri, '{ONTOLOGY}total', CAST(o_totalprice AS VARCHAR), 'literal', '{FLOAT}' FROM o
UNION ALL SELECT row_iri, '{ONTOLOGY}priority', o_orderpriority, 'literal', '{STRING}' FROM o
"""


@query(_ORDER_TRIPLES)
def order_triples(spark, sf_dir):
    """The graph of a page for each customer: the flagship extraction."""
    return mapping.graph(mapping.make_triples(joined(order_pages(spark, sf_dir)), rule_frame(spark, *ORDER_RULES)))


@query(_NATION_ROWS + f"SELECT row_iri AS s, '{ONTOLOGY}area' AS p, r_name AS o FROM r UNION ALL SELECT row_iri, '{ONTOLOGY}number', n_nationkey || '.0' FROM r")
def rule_precedence(spark, sf_dir):
    """A strict rule wins even if it is empty; others fall back to the loose one."""
    given = (("section", "SECTION_Nations", "nation"), ("strict", "Nations_Nation", ""), ("loose", "Nation", "name"), ("strict", "Nations_Region", "area"), ("loose", "Region", "partOf"), ("loose", "Key", "number"))
    return mapping.make_triples(joined(nation_pages(spark, sf_dir)), rule_frame(spark, *given)).where("kind = 'cell'").select("s", "p", "o")


@query(_NATION_ROWS + f"""
SELECT row_iri AS s, CASE WHEN n_nationkey % 2 = 0 THEN '{BASE}' || replace(n_name, ' ', '_') ELSE n_name END AS o, CASE WHEN n_nationkey % 2 = 0 THEN 'iri' ELSE 'literal' END AS o_kind FROM r
""")
def entity_link(spark, sf_dir):
    """Texts that name a known resource become its address."""
    known = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit(BASE), fn.resource_key(F.col("n_name"))).alias("s"), F.lit("p").alias("p"), F.lit("o").alias("o"))
    found = mapping.make_triples(joined(nation_pages(spark, sf_dir)), rule_frame(spark, *NATION_RULES), kb=known)
    return found.where(f"p = '{ONTOLOGY}name'").select("s", "o", "o_kind")


@query(_NATION_ROWS + f", t AS ({_NATION_TRIPLES}) SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' ELSE '\"' || o || '\"^^<' || datatype || '>' END || ' .' AS value FROM t")
def ntriples(spark, sf_dir):
    """The graph as lines."""
    return ntriples_lines(mapping.graph(nation_triples(spark, sf_dir)))


@query(_NATION_ROWS + f", t AS ({_NATION_TRIPLES}), x AS (SELECT s, p, CASE WHEN o_kind = 'iri' THEN '<' || o || '>' ELSE '\"' || o || '\"^^<' || datatype || '>' END AS v FROM t) SELECT '<' || s || '> <' || p || '> ' || string_agg(v, ',' || chr(10) || '        ' ORDER BY v) || ' .' AS value FROM x GROUP BY s, p")
def turtle(spark, sf_dir):
    """The graph in blocks."""
    return turtle_blocks(mapping.graph(nation_triples(spark, sf_dir)))


@query("""
WITH n AS (SELECT count(*) AS pages FROM region), o AS (SELECT count(*) AS k FROM nation)
SELECT pages AS resources_analysed, pages AS tables_found, CAST(0 AS BIGINT) AS no_header_tables, CAST(0 AS BIGINT) AS data_errors, CAST(0 AS BIGINT) AS unresolved_headers,
       k AS rows_extracted, 3 * k AS cells_extracted, 3 * k AS cells_to_map, CAST(0 AS BIGINT) AS unmapped_sections, pages AS unmapped_headers,
       k AS row_triples, 2 * k AS cell_triples, 3 * k AS triples, 3 * k AS graph_size, round(2.0::DOUBLE / 3, 3) AS effectiveness FROM n, o
""")
def full_report(spark, sf_dir):
    """Metrics of an extraction with one header unmapped."""
    return run.extract(nation_pages(spark, sf_dir), rule_frame(spark, *NATION_RULES[:3])).report


@query("""
WITH o AS (SELECT count(*) AS k, count(DISTINCT o_custkey) AS pages FROM orders)
SELECT pages AS resources_analysed, pages AS tables_found, CAST(0 AS BIGINT) AS no_header_tables, CAST(0 AS BIGINT) AS data_errors, CAST(0 AS BIGINT) AS unresolved_headers,
       k AS rows_extracted, 4 * k AS cells_extracted, 4 * k AS cells_to_map, CAST(0 AS BIGINT) AS unmapped_sections, pages AS unmapped_headers,
       k AS row_triples, 3 * k AS cell_triples, 4 * k AS triples, 4 * k AS graph_size, 0.75::DOUBLE AS effectiveness FROM o
""")
def order_report(spark, sf_dir):
    """Metrics of the extraction of a page for each customer, one header without a rule."""
    return run.extract(order_pages(spark, sf_dir), rule_frame(spark, *ORDER_RULES[:4])).report


def part_pages(spark, sf_dir, html) -> DataFrame:
    """A page for each part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("Part_"), F.col("p_partkey").cast("string")).alias("resource"), html.alias("html"))


@query("""
SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN 'E2' WHEN 1 THEN 'E3' WHEN 2 THEN 'E3' ELSE 'OK' END AS status, CAST(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS INTEGER) AS header_rows FROM part
""")
def table_status(spark, sf_dir):
    """Tables without headers, without data, with headers that can't be merged, and good ones."""
    name, head = escaped(F.col("p_name")), head_html("A", "B")
    body = F.when(F.col("p_partkey") % 4 == 0, row_html(name, name)).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit(head + "<tr><th>C</th></tr>"), row_html(name, name))).when(F.col("p_partkey") % 4 == 2, F.lit(head))
    body = F.coalesce(body, F.concat(F.lit(head + "<tr><th>C</th><th>D</th></tr>"), row_html(name, name)))
    found = parsed(part_pages(spark, sf_dir, F.concat(F.lit('<table class="wikitable">'), body, F.lit("</table>"))))
    return found.select("page_id", "status", F.size("headers_raw").alias("header_rows"))


def vertical_pages(spark, sf_dir):
    """A table for each part with its headers beside the data, one of them with a space that doesn't break."""
    line = lambda head, value: F.concat(F.lit("<tr>"), tags("th", F.lit(head)), tags("td", value), F.lit("</tr>"))
    rows = F.concat(line("Na&nbsp;me", escaped(F.col("p_name"))), line("Brand?", escaped(F.col("p_brand"))), line("Size", F.col("p_size").cast("string")))
    return part_pages(spark, sf_dir, F.concat(F.lit('<table class="wikitable">'), rows, F.lit("</table>")))


@query("SELECT p_partkey AS page_id, true AS vertical, 'Name|Brand.|Size' AS headers_refined FROM part")
def vertical_headers(spark, sf_dir):
    """Headers beside their data: the first cell of every row."""
    found = parsed(vertical_pages(spark, sf_dir))
    return found.select("page_id", "vertical", F.array_join("headers_refined", "|").alias("headers_refined"))


@query("""
SELECT p_partkey AS page_id, CAST(r.row_ord AS INTEGER) AS row_ord, 'Name' AS header,
       CASE r.row_ord WHEN 0 THEN 'Na me' WHEN 1 THEN p_name WHEN 2 THEN 'Brand?' WHEN 3 THEN p_brand WHEN 4 THEN 'Size' ELSE p_size || '.0' END AS value
FROM part, range(6) r(row_ord)
""")
def vertical_rows(spark, sf_dir):
    """Rows of such a table as they join its one header row: a cell each."""
    return long_cells(joined(vertical_pages(spark, sf_dir))).select("page_id", "row_ord", F.col("cell.header").alias("header"), F.col("cell.value").alias("value"))


@query("SELECT p_partkey AS page_id, h.header, p_brand AS value FROM part, (VALUES ('A'), ('B'), ('C')) h(header)")
def data_colspan(spark, sf_dir):
    """A cell over three columns is a cell of each."""
    html = F.concat(F.lit('<table class="wikitable"><tr><th>A</th><th>B</th><th>C</th></tr><tr><td colspan="3">'), escaped(F.col("p_brand")), F.lit("</td></tr></table>"))
    return long_cells(joined(part_pages(spark, sf_dir, html))).select("page_id", F.col("cell.header").alias("header"), F.col("cell.value").alias("value"))


@query("SELECT p_partkey AS page_id, p_name AS value, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name || ' (part)', ' ', '_') ELSE replace(p_name, ' ', '_') END AS link FROM part")
def new_links(spark, sf_dir):
    """Anchors to pages that don't exist have their text as link, others their title."""
    name = escaped(F.col("p_name"))
    link = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('<a href="/x" title="'), name, F.lit(' (part)">'), name, F.lit("</a>"))).otherwise(F.concat(F.lit('<a class="new" href="/x" title="no such page">'), name, F.lit("</a>")))
    found = long_cells(joined(part_pages(spark, sf_dir, F.concat(F.lit('<table class="wikitable"><tr><th>Part</th></tr>'), row_html(link), F.lit("</table>")))))
    return found.select("page_id", F.col("cell.value").alias("value"), F.get("cell.links", F.lit(0)).alias("link"))


_LETTERS = "[lower({0}[i:i]) FOR i IN range(1, length({0}) + 1) IF {0}[i:i] <> lower({0}[i:i]) OR NOT contains(lower({0}[1:i-1]), {0}[i:i])]"
_DISTANCE = "CAST(len([c FOR c IN x IF NOT list_contains(y, c)]) + len([c FOR c IN y IF NOT list_contains(x, c)]) AS INTEGER)"


@query(f"""
WITH p AS (SELECT p_partkey, replace(p_name, ' ', '') AS a, replace(p_brand || ' ' || upper(p_name), ' ', '') AS b FROM part)
SELECT p_partkey, {_DISTANCE} AS distance FROM (SELECT p_partkey, {_LETTERS.format("a")} AS x, {_LETTERS.format("b")} AS y FROM p)
""")
def letter_distances(spark, sf_dir):
    """How far a part's name is from its brand with the name in upper case."""
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", fn.letter_distance(F.col("p_name"), F.concat("p_brand", F.lit(" "), F.upper("p_name"))).alias("distance"))


@query(f"""
WITH p AS (SELECT p_partkey, replace(p_name, ' ', '') AS a, replace(CASE WHEN p_partkey % 3 = 0 THEN p_name || 'z' ELSE p_type END, ' ', '') AS b FROM part)
SELECT p_partkey AS page_id, {_DISTANCE} >= 7 AS removed FROM (SELECT p_partkey, {_LETTERS.format("b")} AS x, {_LETTERS.format("a")} AS y FROM p)
""")
def summary_by_name(spark, sf_dir):
    """A last row with the sums of those above is no data if its name is far from the one above."""
    last = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("z"))).otherwise(F.col("p_type"))
    rows = F.concat(row_html(F.lit("first"), F.lit("3"), F.lit("4")), row_html(escaped(F.col("p_name")), F.lit("5"), F.lit("6")), row_html(escaped(last), F.lit("8"), F.lit("10")))
    found = joined(part_pages(spark, sf_dir, F.concat(F.lit('<table class="wikitable">' + head_html("Name", "X", "Y")), rows, F.lit("</table>"))))
    return found.select("page_id", F.element_at("rows", -1)["removed"].alias("removed"))


@query("""
WITH n AS (SELECT count(*) AS p FROM part)
SELECT p AS resources_analysed, p AS tables_found, 3 * p AS rows_extracted, 9 * p - (SELECT count(*) FROM part WHERE p_partkey % 5 = 0) AS cells_extracted,
       6 * p - (SELECT count(*) FROM part WHERE p_partkey % 5 = 0) AS cells_to_map FROM n
""")
def removed_rows_report(spark, sf_dir):
    """Cells of removed rows are extracted and not to be mapped; empty cells are neither."""
    first = F.when(F.col("p_partkey") % 5 == 0, "").otherwise("one")
    rows = F.concat(row_html(first, F.lit("3"), F.lit("4")), row_html(F.lit("two"), F.lit("5"), F.lit("6")), F.lit(""))
    rows = F.concat(rows, row_html(F.lit("Grand sum of all"), F.lit("8"), F.lit("10")))
    pages = part_pages(spark, sf_dir, F.concat(F.lit('<table class="wikitable">' + head_html("Name", "X", "Y")), rows, F.lit("</table>")))
    return run.extract(pages, rule_frame(spark, ("loose", "X", "x"))).report.select("resources_analysed", "tables_found", "rows_extracted", "cells_extracted", "cells_to_map")


def mixed_pages(spark, sf_dir):
    """A page for each customer: two tables with a rule, and between them one without, of one, two and three rows."""
    block = lambda section, n: table_html(F.concat(*(row_html(F.concat("c_name", F.lit(f" {section}{i}"))) for i in range(n))), head_html("Item"), F.lit(section))
    html = F.concat(block("First", 1), block("Unknown", 2), block("Last", 3))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("It's_"), F.col("c_custkey").cast("string")).alias("resource"), html.alias("html"))


@query(f"""
SELECT '{BASE}Its_' || c_custkey AS s, '{ONTOLOGY}' || t.p AS p, '{BASE}Its_' || c_custkey || '__' || t.i AS o, c_name || t.item AS item
FROM customer, (VALUES (1, 'a', ' First0'), (2, 'b', ' Last0'), (3, 'b', ' Last1'), (4, 'b', ' Last2')) t(i, p, item)
""")
def row_numbers(spark, sf_dir):
    """Rows are numbered over the tables that have a rule, and only over these; quotes are no part of a subject."""
    found = mapping.make_triples(joined(mixed_pages(spark, sf_dir)), rule_frame(spark, ("section", "SECTION_First", "a"), ("section", "SECTION_Last", "b"), ("loose", "Item", "item")))
    of_row = lambda c: F.max(F.when(F.col("kind") == "row", F.col(c))).alias(c)
    rows = found.groupBy(F.when(F.col("kind") == "row", F.col("o")).otherwise(F.col("s")).alias("row_of")).agg(of_row("s"), of_row("p"), F.collect_list(F.when(F.col("kind") == "cell", F.col("o"))).alias("items"))
    return rows.select("s", "p", F.col("row_of").alias("o"), F.explode("items").alias("item"))


@query("SELECT count(*) AS resources_analysed, 3 * count(*) AS tables_found, count(*) AS unmapped_sections, 2 * count(*) AS unmapped_headers FROM customer")
def unmapped_report(spark, sf_dir):
    """Sections and headers without a rule, counted once a table."""
    found = run.extract(mixed_pages(spark, sf_dir), rule_frame(spark, ("section", "SECTION_First", "a"), ("section", "SECTION_Last", "b"), ("strict", "First_Item", "item"))).report
    return found.select("resources_analysed", "tables_found", "unmapped_sections", "unmapped_headers")


@query(f"SELECT DISTINCT '{BASE}P' AS s, '{ONTOLOGY}brand' AS p, p_brand AS o FROM part")
def graph_is_a_set(spark, sf_dir):
    """A triple that many rows give is one."""
    cells = table(spark, sf_dir, "part").select(F.lit(BASE + "P").alias("s"), F.lit(ONTOLOGY + "brand").alias("p"), F.col("p_brand").alias("o"), F.lit("literal").alias("o_kind"), F.lit(STRING).alias("datatype"))
    return mapping.graph(cells).select("s", "p", "o")


@query("""
SELECT CASE WHEN p LIKE '%order' THEN 'own' WHEN p LIKE '%label' THEN 'own' ELSE 'fallback' END AS source, count(*) AS n
FROM orders, (VALUES ('order'), ('label'), ('status')) t(p) GROUP BY 1
""")
def fallback_chapter(spark, sf_dir):
    """Rules of a chapter, and of the main one where it has none."""
    own = rule_frame(spark, ("section", "SECTION_Orders", "order"), ("loose", "Order", "label"), chapter="it")
    other = rule_frame(spark, ("section", "SECTION_Orders", "no"), ("loose", "Order", "no"), ("loose", "Status", "status"))
    found = run.extract(order_pages(spark, sf_dir), own.unionByName(other), "it", fallback="en").triples
    good = found.where(F.col("s").startswith("http://it.kb.example.org/resource/"))
    return good.groupBy(F.when(F.col("p").isin(ONTOLOGY + "order", ONTOLOGY + "label"), "own").when(F.col("p") == ONTOLOGY + "status", "fallback").otherwise("wrong").alias("source")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- rules


def nation_template(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    section = F.concat(F.replace("n_name", F.lit(" "), F.lit("_")), F.lit("_tte_"), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit("_2"))
    own = n.select(section.alias("section"), F.lit("sectionProperty").alias("header"), F.concat(F.lit("p-"), F.col("n_nationkey").cast("string"), F.lit(" x")).alias("property"))
    return own.unionByName(n.select(section.alias("section"), F.concat(F.lit("H "), F.col("n_regionkey").cast("string")).alias("header"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("some.Prop")).otherwise("").alias("property")))


@query("""
WITH s AS (SELECT *, unnest([replace(n_name, '_', ' '), replace(n_name, '_', ' ') || ' 2']) AS section FROM nation)
SELECT 'section' AS kind, 'SECTION_' || section AS key, 'p' || n_nationkey || 'x' AS property FROM s
UNION ALL SELECT 'strict', section || '_H ' || n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN 'someProp' ELSE '' END FROM s
""")
def rules_parse(spark, sf_dir):
    """A template as rules."""
    return rules.parse_rules(nation_template(spark, sf_dir), "en").select("kind", "key", "property")


@query("""
SELECT n_name AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE 'old' END AS property FROM nation WHERE n_nationkey % 3 <> 1
UNION ALL SELECT 'added', 'new'
""")
def rules_upsert_delete(spark, sf_dir):
    """New rules replace, add and delete."""
    n = table(spark, sf_dir, "nation")
    shape = lambda df, p: df.select(F.lit("en").alias("chapter"), F.lit("loose").alias("kind"), F.lit(None).cast("string").alias("section"), F.col("n_name").alias("header"), F.col("n_name").alias("key"), p.alias("property"))
    new = shape(n.where("n_nationkey % 3 <> 2"), F.when(F.col("n_nationkey") % 3 == 0, "new").otherwise(""))
    return rules.upsert_rules(shape(n, F.lit("old")), new.unionByName(rule_frame(spark, ("loose", "added", "new")))).select("key", "property")


@query("SELECT n_name AS key, n_nationkey % 2 = 0 AS known FROM nation")
def rules_ontology_check(spark, sf_dir):
    """Rules whose property is in the store, and those whose isn't."""
    n = table(spark, sf_dir, "nation")
    store = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit(ONTOLOGY + "p"), F.col("n_nationkey").cast("string")).alias("s"), F.lit("type").alias("p"), F.lit("http://www.w3.org/2002/07/owl#DatatypeProperty").alias("o"))
    given = n.select(F.lit("en").alias("chapter"), F.lit("loose").alias("kind"), F.lit(None).cast("string").alias("section"), F.col("n_name").alias("header"), F.col("n_name").alias("key"), F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("property"))
    good, bad = rules.check_ontology(given, store)
    return good.select("key", F.lit(True).alias("known")).unionByName(bad.select("key", F.lit(False).alias("known")))


# ---------------------------------------------------------------- the store of triples


def customer_store(spark, sf_dir):
    """Customers as triples: class, nation, segment, page id and label."""
    c = table(spark, sf_dir, "customer").withColumn("s", F.concat(F.lit(BASE), F.col("c_name"), F.when(F.col("c_custkey") % 10 == 0, F.lit("/part")).otherwise("")))
    make = lambda p, o, lang=None: c.select("s", F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(lang).cast("string").alias("lang"))
    return (
        make(kb.TYPE, F.concat(F.lit(ONTOLOGY + "Class"), F.col("c_nationkey").cast("string")))
        .unionByName(make(ONTOLOGY + "nation", F.concat(F.lit(BASE + "N"), F.col("c_nationkey").cast("string"))))
        .unionByName(make(ONTOLOGY + "segment", F.col("c_mktsegment")))
        .unionByName(make(ONTOLOGY + "wikiPageID", F.col("c_custkey")))
        .unionByName(make(kb.LABEL, F.lower("c_name"), "en"))
    )


@query("SELECT DISTINCT c_name AS resource FROM customer WHERE c_nationkey = 3")
def resource_select(spark, sf_dir):
    """Names of the members of a class; a name ends at a slash."""
    return kb.resource_names(kb.of_class(customer_store(spark, sf_dir), ONTOLOGY + "Class3"))


@query("SELECT count(DISTINCT c_custkey) AS res_num FROM customer")
def resource_count(spark, sf_dir):
    return kb.count_resources(kb.topic_subjects(customer_store(spark, sf_dir), "all", ONTOLOGY))


@query(f"SELECT s FROM (SELECT DISTINCT '{BASE}' || c_name || CASE WHEN c_custkey % 10 = 0 THEN '/part' ELSE '' END AS s FROM customer) ORDER BY s LIMIT 20 OFFSET 40")
def resource_page(spark, sf_dir):
    return kb.resource_page(customer_store(spark, sf_dir), 20, 40)


@query(f"""
SELECT '{BASE}' || a.c_name || CASE WHEN a.c_custkey % 10 = 0 THEN '/part' ELSE '' END AS s, a.c_mktsegment AS seg
FROM customer a WHERE a.c_nationkey < 1 + 4 AND a.c_nationkey = 4 AND a.c_custkey > 100 AND a.c_mktsegment <> 'BUILDING'
""")
def bgp_join(spark, sf_dir):
    """A pattern of three triples with comparisons."""
    where = f"?s <{ONTOLOGY}nation> <{BASE}N4> . ?s <{ONTOLOGY}segment> ?seg . ?s <{ONTOLOGY}wikiPageID> ?id . FILTER(?id > 100) FILTER(?seg != \"BUILDING\")"
    return kb.match_patterns(customer_store(spark, sf_dir), where).select("s", "seg")


@query(f"""
WITH o AS (SELECT o_orderkey, o_custkey FROM orders)
SELECT '{BASE}O' || l_orderkey AS "order", '{BASE}N' || c_nationkey AS nation, count(*) AS n_lines
FROM lineitem JOIN o ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
""")
def bgp_chain(spark, sf_dir):
    """Lines to orders to customers to nations, as patterns over triples."""
    make = lambda df, s, p, o: df.select(F.concat(F.lit(BASE), *s).alias("s"), F.lit(ONTOLOGY + p).alias("p"), F.concat(F.lit(BASE), *o).alias("o"))
    text = lambda c: F.col(c).cast("string")
    lines = make(table(spark, sf_dir, "lineitem"), (F.lit("L"), text("l_orderkey"), F.lit("_"), text("l_linenumber")), "of", (F.lit("O"), text("l_orderkey")))
    orders = make(table(spark, sf_dir, "orders"), (F.lit("O"), text("o_orderkey")), "by", (F.lit("C"), text("o_custkey")))
    people = make(table(spark, sf_dir, "customer"), (F.lit("C"), text("c_custkey")), "in", (F.lit("N"), text("c_nationkey")))
    found = kb.match_patterns(lines.unionByName(orders).unionByName(people), f"?line <{ONTOLOGY}of> ?order. ?order <{ONTOLOGY}by> ?who. ?who <{ONTOLOGY}in> ?nation")
    return found.groupBy("order", "nation").agg(F.count(F.lit(1)).alias("n_lines"))


@query("SELECT c_name AS header, replace(c_name, '#', '') AS property FROM customer")
def label_lookup(spark, sf_dir):
    """Properties by the label of a header, as written or in lower case."""
    c = table(spark, sf_dir, "customer")
    make = lambda base, name: c.select(F.concat(F.lit(base), name).alias("s"), F.lit(kb.LABEL).alias("p"), F.lower("c_name").alias("o"), F.lit("en").alias("lang"))
    name = F.replace("c_name", F.lit("#"), F.lit(""))
    return kb.property_by_label(c.select(F.col("c_name").alias("header")), make(ONTOLOGY, name).unionByName(make("http://aa.example.org/entity/", name)), "en")


@query("SELECT n_name AS resource FROM nation WHERE n_nationkey % 2 = 0")
def resource_exists(spark, sf_dir):
    """Names that are subjects of the store."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("resource"), "n_nationkey")
    return kb.exists_in(n.select("resource"), n.where("n_nationkey % 2 = 0").select(F.col("resource").alias("s")), "resource")


@query("""
SELECT 'Class' || n AS class, n IN (SELECT c_nationkey FROM customer) AS known FROM range(30) t(n)
""")
def class_check(spark, sf_dir):
    """Classes that are subjects of the store."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit(ONTOLOGY + "Class"), F.col("c_nationkey").cast("string")).alias("s")).distinct()
    asked = spark.range(30).select(F.concat(F.lit("Class"), F.col("id").cast("string")).alias("class"), F.concat(F.lit(ONTOLOGY + "Class"), F.col("id").cast("string")).alias("s"))
    return kb.known_classes(asked, c).select("class", "known")


@query(f"""
SELECT c_name AS who, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 9000 THEN 'rich' END AS state, o_orderpriority AS priority
FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '5%')
""")
def pattern_options(spark, sf_dir):
    """Prefixes, lists of properties and objects, an option, and either of two."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    make = lambda df, s, p, value: df.select(F.concat(F.lit(BASE), s).alias("s"), F.lit(ONTOLOGY + p).alias("p"), value.cast("string").alias("o"))
    state = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") > 9000, "rich")
    one, order = F.concat(F.lit("C"), F.col("c_custkey").cast("string")), F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))
    store = make(c, one, "name", F.col("c_name")).unionByName(make(c, one, "segment", F.col("c_mktsegment"))).unionByName(make(c.where(state.isNotNull()), one, "state", state))
    store = store.unionByName(make(o, order, "by", F.concat(F.lit(BASE + "C"), F.col("o_custkey").cast("string")))).unionByName(make(o, order, "priority", F.col("o_orderpriority")))
    where = f"""PREFIX k: <{ONTOLOGY}> ?c k:segment "BUILDING" ; k:name ?who . ?o k:by ?c ; k:priority ?priority . OPTIONAL {{ ?c k:state ?state }}
    {{ ?o k:priority "1-URGENT" }} UNION {{ ?o k:priority "5-LOW" }}"""
    return kb.match_patterns(store, where).select("who", "state", "priority")


def property_of(df: DataFrame, subject, name: str, value) -> DataFrame:
    """A property of each row as a triple."""
    return df.select(F.concat(F.lit(BASE), subject).alias("s"), F.lit(ONTOLOGY + name).alias("p"), value.cast("string").alias("o"))


def order_store(spark, sf_dir) -> DataFrame:
    """Orders and their customers as triples: by, status, priority, part of each line, the customer's next order; segment, name and, of some, state."""
    c, o, lines = (table(spark, sf_dir, x) for x in ("customer", "orders", "lineitem"))
    one = lambda name: F.concat(F.lit("C"), F.col(name).cast("string"))
    order = lambda name: F.concat(F.lit("O"), F.col(name).cast("string"))
    state = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") > 9000, "rich")
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    every = [
        property_of(c, one("c_custkey"), "name", F.col("c_name")),
        property_of(c, one("c_custkey"), "segment", F.col("c_mktsegment")),
        property_of(c.where(state.isNotNull()), one("c_custkey"), "state", state),
        property_of(o, order("o_orderkey"), "by", F.concat(F.lit(BASE), one("o_custkey"))),
        property_of(o, order("o_orderkey"), "status", F.col("o_orderstatus")),
        property_of(o, order("o_orderkey"), "priority", F.col("o_orderpriority")),
        property_of(o.withColumn("after", after).where("after is not null"), order("o_orderkey"), "next", F.concat(F.lit(BASE), order("after"))),
        property_of(lines, order("l_orderkey"), "part", F.concat(F.lit("P"), F.col("l_partkey").cast("string"))),
    ]
    return functools.reduce(DataFrame.unionByName, every)


@query(f"""
WITH c AS (SELECT *, CASE WHEN c_acctbal < 0 THEN 'debt' END AS state FROM customer)
SELECT c_name AS who, state, '{BASE}O' || o_orderkey AS o, o_orderpriority AS priority FROM c LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority > '2' WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT c_name, state, '{BASE}O' || o_orderkey, NULL FROM c JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'
""")
def pattern_unbound(spark, sf_dir):
    """Filters that decide on an option, a variable that one branch of a union leaves unbound, and an option that meets it."""
    where = f"""PREFIX k: <{ONTOLOGY}> ?c k:name ?who OPTIONAL {{ ?c k:state ?state . FILTER(?state != "rich") }}
    {{ ?c k:segment "BUILDING" }} UNION {{ ?o k:by ?c ; k:priority "1-URGENT" }} OPTIONAL {{ ?o k:by ?c ; k:priority ?priority FILTER(?priority > "2") }}"""
    return kb.match_patterns(order_store(spark, sf_dir), where).select("who", "state", "o", "priority")


@query("""
SELECT c_name AS who FROM customer WHERE c_acctbal BETWEEN 0 AND 9000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority >= '4')
""")
def pattern_excluded(spark, sf_dir):
    """What a pattern excludes, what must not exist, and what must."""
    where = f"""PREFIX k: <{ONTOLOGY}> ?c k:name ?who MINUS {{ ?c k:state ?state }} FILTER NOT EXISTS {{ ?o k:by ?c . ?o k:priority "1-URGENT" }}
    FILTER EXISTS {{ ?o k:by ?c ; k:status ?status ; k:priority ?priority FILTER(?status = "F" || ?priority >= "4") }}"""
    return kb.match_patterns(order_store(spark, sf_dir), where).select("who")


@query(f"""
SELECT '{BASE}O' || o_orderkey AS o, '{BASE}C' || o_custkey AS c, o_orderstatus AS status, o_orderpriority AS priority, 'P' || l_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'
""")
def star_properties(spark, sf_dir):
    """Properties of one subject at once, one of which may have many values."""
    where = f"""PREFIX k: <{ONTOLOGY}> ?o k:by ?c ; k:status ?status ; k:priority ?priority ; k:part ?part . FILTER(?status != "P")"""
    return kb.match_patterns(order_store(spark, sf_dir), where).select("o", "c", "status", "priority", "part")


@query(f"""
SELECT '{BASE}O' || a.o_orderkey AS a, '{BASE}O' || b.o_orderkey AS b, b.o_orderstatus AS status FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
""")
def path_closure(spark, sf_dir):
    """All later orders of a customer, by as many steps as it takes."""
    return kb.match_patterns(order_store(spark, sf_dir), f"PREFIX k: <{ONTOLOGY}> ?a k:next+ ?b . ?b k:status ?status").select("a", "b", "status")


@query("""
SELECT a.c_name AS one, b.c_name AS other FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P') x
JOIN (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P') y ON x.l_partkey = y.l_partkey JOIN customer a ON a.c_custkey = x.o_custkey JOIN customer b ON b.c_custkey = y.o_custkey
WHERE a.c_name < b.c_name GROUP BY 1, 2
""")
def path_sequence(spark, sf_dir):
    """Customers whose orders under way have a part in common: a way there and back along inverse steps."""
    where = f"""PREFIX k: <{ONTOLOGY}> ?o k:status "P" ; k:part ?part ; k:by/k:name ?one . ?part ^k:part ?p . ?p k:status "P" ; k:by/k:name ?other . FILTER(?one < ?other)"""
    return kb.match_patterns(order_store(spark, sf_dir), where).select("one", "other").distinct()


@query("""
SELECT t.topic, count(*) AS n FROM customer, (VALUES ('soccer', 0), ('act', 1), ('writer', 2), ('dir', 3)) t(topic, k) WHERE c_custkey % 4 = t.k GROUP BY 1
""")
def topics(spark, sf_dir):
    """Members of each named topic; directors by their films."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(BASE), "c_name").alias("s"), F.concat(F.lit(BASE + "Film"), F.col("c_custkey").cast("string")).alias("film"))
    kind = F.element_at(F.array(*(F.lit(ONTOLOGY + x) for x in ("SoccerPlayer", "Actor", "Writer", "Director"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    store = c.select("s", F.lit(kb.TYPE).alias("p"), kind.alias("o")).unionByName(c.select("s", F.lit(ONTOLOGY + "wikiPageID").alias("p"), F.col("c_custkey").cast("string").alias("o")))
    films = c.where("c_custkey % 4 = 3")
    store = store.unionByName(films.select(F.col("film").alias("s"), F.lit(kb.TYPE).alias("p"), F.lit(ONTOLOGY + "Film").alias("o"))).unionByName(films.select(F.col("film").alias("s"), F.lit(ONTOLOGY + "director").alias("p"), F.col("s").alias("o")))
    each = [kb.topic_subjects(store, topic, ONTOLOGY).groupBy(F.lit(topic).alias("topic")).agg(F.count(F.lit(1)).alias("n")) for topic in ("soccer", "act", "writer", "dir")]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


# ---------------------------------------------------------------- lists, rules and templates as files


def written(spark, name: str) -> str:
    """A new path for a file of a query, in the shared folder, that goes when the program ends."""
    scratch = Scratch(spark, "files")
    scratch.save(spark.range(0), "empty")
    return f"{scratch.root}/{name}"


@query("SELECT 'Customer_' || c_custkey AS resource FROM customer")
def resource_list(spark, sf_dir):
    """A list of names, written and read."""
    path = written(spark, "names")
    sinks.write_resources(table(spark, sf_dir, "customer").select(F.concat(F.lit("Customer_"), F.col("c_custkey").cast("string")).alias("resource")), path)
    return read_resources(spark, path).select("resource")


@query(_ORDER_TRIPLES)
def store_roundtrip(spark, sf_dir):
    """The graph of the order pages written as Turtle and read again."""
    path = written(spark, "turtle")
    sinks.write_graph(order_triples(spark, sf_dir), path, "turtle")
    return read_triples(spark, path).select("s", "p", "o", "o_kind", "datatype")


@query(f"SELECT run, s, p, o, o_kind, datatype FROM ({_ORDER_TRIPLES}), (VALUES ('a'), ('b')) AS runs(run) WHERE (o_kind = 'iri') = (run = 'a')")
def committed_runs(spark, sf_dir):
    """The graph of the order pages committed in two runs, one of them twice, and read again."""
    path = written(spark, "runs")
    found = Scratch(spark, "graph").save(order_triples(spark, sf_dir), "graph")
    for run, kind in ("a", "iri"), ("b", "literal"), ("a", "iri"):
        sinks.write_graph(found.where(F.col("o_kind") == kind), path, run=run)
    parts = [read_triples(spark, f"{path}/run={x}").select(F.lit(x).alias("run"), "s", "p", "o", "o_kind", "datatype") for x in "ab"]
    return parts[0].unionByName(parts[1])


@query(f"""
SELECT '{BASE}C' || c_custkey AS s, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_mktsegment <> 'BUILDING'
""")
def store_patterns(spark, sf_dir):
    """Patterns over a store that was written as N-Triples, of which some properties alone are read."""
    path = written(spark, "ntriples")
    store = order_store(spark, sf_dir)
    known = store.withColumn("o_kind", F.when(F.col("o").startswith("http"), "iri").otherwise("literal")).withColumn("datatype", F.lit(None).cast("string"))
    sinks.write_graph(known, path)
    read = read_triples(spark, path, [ONTOLOGY + "name", ONTOLOGY + "segment"])
    return kb.match_patterns(read, f'PREFIX k: <{ONTOLOGY}> ?s k:name ?name ; k:segment ?segment . FILTER(?segment != "BUILDING")')


def order_answers(spark, sf_dir) -> DataFrame:
    """What a service may answer when it is asked for each customer's orders: bindings, a cut-off text, a message, nothing."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    term = lambda k: F.struct(F.struct(F.lit("uri").alias("type"), F.concat(F.lit(BASE + "O"), k.cast("string")).alias("value")).alias("res"))
    whole = F.to_json(F.struct(F.struct(F.transform("keys", term).alias("bindings")).alias("results")))
    message = F.lit('{"message": "Error: too many requests"}')
    k = F.col("o_custkey") % 5
    body = F.when(k == 0, F.substring(whole, F.lit(1), F.length(whole) - 7)).when(k == 1, message).when((k == 2) & (F.col("o_custkey") % 2 == 0), F.lit("Error 503")).when(k == 2, F.lit(" ")).otherwise(whole)
    return o.select(F.col("o_custkey").alias("page_id"), body.alias("body"))


@query(f"""
SELECT page_id, status, CASE WHEN status = 'OK' THEN n ELSE 0 END AS n, CASE WHEN status = 'OK' THEN last END AS last
FROM (SELECT o_custkey AS page_id, CASE WHEN o_custkey % 5 = 0 THEN 'MALFORMED' WHEN o_custkey % 5 = 1 OR o_custkey % 10 = 2 THEN 'ERROR' WHEN o_custkey % 5 = 2 THEN 'MISSING' ELSE 'OK' END AS status,
        count(*) AS n, '{BASE}O' || max(o_orderkey) AS last FROM orders GROUP BY 1)
""")
def json_answers(spark, sf_dir):
    """The bindings of good answers, and the status of the others."""
    asked = order_answers(spark, sf_dir)
    found = answers.bindings(asked).where("variable = 'res'").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("value", "place").alias("last"))
    return answers.parsed(asked).select("page_id", "status").join(found, "page_id", "left").select("page_id", "status", F.coalesce("n", F.lit(0)).alias("n"), "last")


@query("""
SELECT c_custkey AS page_id, CAST(CASE WHEN c_custkey % 4 < 2 THEN c_custkey % 7 ELSE 0 END AS BIGINT) AS n, c_custkey % 4 >= 2 AS lost FROM customer
""")
def json_structures(spark, sf_dir):
    """Structures that answers list for pages, and pages whose answer is a message or no JSON."""
    c = table(spark, sf_dir, "customer")
    listed = F.to_json(F.struct(F.transform(F.slice(F.sequence(F.lit(1), F.lit(7)), F.lit(1), (F.col("c_custkey") % 7).cast("int")), lambda i: F.struct(i.alias("rows"), F.lit("wikitable").alias("class"))).alias("result")))
    body = F.when(F.col("c_custkey") % 4 < 2, listed).when(F.col("c_custkey") % 4 == 2, F.lit('{"message": "no such page", "code": 404}')).otherwise(F.lit("<html>"))
    return answers.structures(c.select(F.col("c_custkey").alias("page_id"), body.alias("body"))).select("page_id", "n", "lost")


@query("SELECT o_custkey AS page_id, count(*) AS n FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1")
def chosen_pages(spark, sf_dir):
    """The page of one name and those of a list, and their rows."""
    first = table(spark, sf_dir, "orders").agg(F.min("o_custkey")).first()[0]
    pages = Scratch(spark, "pages").save(order_pages(spark, sf_dir), "pages")
    listed = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("Customer_"), F.col("c_custkey").cast("string")).alias("resource"))
    single = one_resource(spark, f"Customer_{first}").join(run.choose(pages, single=f"Customer_{first}"), "resource").select(*pages.columns)
    both = single.unionByName(run.choose(pages, listed=listed)).distinct()
    return joined(both).select("page_id", F.size("rows").cast("long").alias("n"))


@query("SELECT 'part' AS kind, p_name || '_' || p_partkey AS key, replace(p_brand, '#', '') AS property FROM part")
def rule_versions(spark, sf_dir):
    """A rule base, written as a version and read."""
    own = table(spark, sf_dir, "part").select(F.lit("en").alias("chapter"), F.lit("part").alias("kind"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("header"), F.concat_ws("_", "p_name", "p_partkey").alias("key"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("property"))
    return rules.read_rules(spark, rules.write_rules(own, written(spark, "rules"), "1")).select("kind", "key", "property")


@query("""
WITH s AS (SELECT *, unnest([replace(n_name, '_', ' '), replace(n_name, '_', ' ') || ' 2']) AS section FROM nation)
SELECT 'section' AS kind, 'SECTION_' || section AS key, 'p' || n_nationkey || 'x' AS property, 'it' AS chapter FROM s WHERE n_nationkey % 2 = 0
UNION ALL SELECT 'strict', section || '_H ' || n_regionkey, 'someProp', 'it' FROM s WHERE n_nationkey % 2 = 0
UNION ALL SELECT 'loose', 'old', 'kept', 'it'
""")
def rules_update(spark, sf_dir):
    """A filled-in template read from its file: parsed, checked against a store, upserted into the rule base."""
    path = written(spark, "template")
    sinks.write_template(nation_template(spark, sf_dir), path, chapter="it", topic="Nation", format="1")
    template, made_for = sinks.read_template(spark, path)
    n = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string"), F.lit("x")).alias("x"))
    known = n.unionByName(spark.createDataFrame([("someProp",)], "x string")).select(F.concat(F.lit(ONTOLOGY), "x").alias("s"), F.lit("type").alias("p"), F.lit("http://www.w3.org/2002/07/owl#ObjectProperty").alias("o"))
    old = rule_frame(spark, ("loose", "old", "kept"), chapter="it")
    return rules.update_rules(old, template, made_for["chapter"], int(made_for["format"]), known).where("property <> ''").select("kind", "key", "property", "chapter")


@query("SELECT 'S ' || r_regionkey AS section, r_name AS header, 'http' AS property, 'Topic' AS topic, 'en' AS chapter, '2' AS format FROM region")
def settings_file(spark, sf_dir):
    """A template with what it was made for, written and read."""
    path = written(spark, "settings")
    made = table(spark, sf_dir, "region").select(F.concat(F.lit("S "), F.col("r_regionkey").cast("string")).alias("section"), F.col("r_name").alias("header"), F.lit("http").alias("property"))
    sinks.write_template(made, path, topic="Topic", chapter="en", format="2")
    template, heading = sinks.read_template(spark, path)
    return template.select("*", *(F.lit(v).alias(k) for k, v in heading.items()))


@query("""
SELECT * FROM (VALUES ('en', 1, 'topic', 'Actor', true), ('xx', 1, 'topic', 'Actor', false), ('it', 2, 'single', 'A b', true), ('en', 3, 'single', 'A', false), ('en', 1, 'topic', 'A1', false), ('en', 1, 'none', '', false), ('en', 1, 'where', '?s a <x>', true))
t(chapter, output_format, choice, value, valid)
""")
def argument_checks(spark, sf_dir):
    """Which arguments a program takes."""
    given = [("en", 1, "topic", "Actor"), ("xx", 1, "topic", "Actor"), ("it", 2, "single", "A b"), ("en", 3, "single", "A"), ("en", 1, "topic", "A1"), ("en", 1, "none", ""), ("en", 1, "where", "?s a <x>")]

    def valid(chapter, form, choice, value):
        try:
            explore.check_arguments(chapter, form, **({} if choice == "none" else {choice: value}))
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(*g, valid(*g)) for g in given], "chapter string, output_format int, choice string, value string, valid boolean")


# ---------------------------------------------------------------- exploration


def section_pages(spark, sf_dir, suffix: str = ""):
    """A page for each nation, with a table under its region's name and one under ``suffix`` behind that."""
    block = lambda section, *names: table_html(row_html(*[F.lit("1")] * len(names)), head_html(*names), section)
    html = F.concat(block(F.col("r_name"), "Name", "Key"), block(F.concat("r_name", F.lit(suffix)), "Name", "Other") if suffix else F.lit(""))
    return region_nations(spark, sf_dir).select(F.col("n_nationkey").cast("long").alias("page_id"), F.replace("n_name", F.lit(" "), F.lit("_")).alias("resource"), html.alias("html"))


def explored(spark, sf_dir, suffix, similar, output_format):
    refined = parsed(section_pages(spark, sf_dir, suffix), data=True)
    own = mapping.chapter_rules(rule_frame(spark, ("loose", "Name", "name"), ("section", "SECTION_ASIA", "asia")), "en")
    sections = explore.section_vocabulary(refined, similar)
    return explore.template(sections, explore.header_vocabulary(refined, sections, own), own, output_format)


_EXAMPLES = "SELECT n_regionkey, string_agg(replace(n_name, ' ', '_'), ', ' ORDER BY n_nationkey) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation) WHERE r <= 3 GROUP BY 1"


@query(f"""
WITH e AS ({_EXAMPLES}), s AS (SELECT replace(r_name, ' ', '_') AS section, r_name, examples FROM region JOIN e ON r_regionkey = n_regionkey)
SELECT section, 'sectionProperty' AS header, CASE WHEN r_name = 'ASIA' THEN 'asia' ELSE '' END AS property, examples FROM s
UNION ALL SELECT section, h.header, h.property, NULL FROM s, (VALUES ('Name', 'name'), ('Key', '')) h(header, property)
""")
def explore_vocab_f1(spark, sf_dir):
    """The template with every header under each section."""
    return explored(spark, sf_dir, "", False, 1)


@query(f"""
WITH e AS ({_EXAMPLES}), s AS (SELECT replace(r_name, ' ', '_') AS section, r_name, examples FROM region JOIN e ON r_regionkey = n_regionkey)
SELECT section, 'sectionProperty' AS header, CASE WHEN r_name = 'ASIA' THEN 'asia' ELSE '' END AS property, examples FROM s
UNION ALL SELECT (SELECT min_by(section, r_name) FROM s), h.header, h.property, NULL FROM (VALUES ('Name', 'name'), ('Key', '')) h(header, property)
""")
def explore_vocab_f2(spark, sf_dir):
    """The template with each header once."""
    return explored(spark, sf_dir, "", False, 2)


@query(f"""
WITH e AS ({_EXAMPLES}), s AS (SELECT replace(r_name || '_tte_' || r_name || ' stats', ' ', '_') AS section, examples FROM region JOIN e ON r_regionkey = n_regionkey)
SELECT section, 'sectionProperty' AS header, '' AS property, examples FROM s
UNION ALL SELECT section, h.header, h.property, NULL FROM s, (VALUES ('Name', 'name'), ('Key', ''), ('Other', '')) h(header, property)
""")
def explore_similar(spark, sf_dir):
    """Sections that contain each other are one group."""
    return explored(spark, sf_dir, " stats", True, 1)


@query("""
WITH s AS (SELECT DISTINCT c_mktsegment AS section FROM customer), e AS (
  SELECT c_mktsegment, string_agg('Customer_' || c_custkey, ', ' ORDER BY c_custkey) AS examples
  FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) WHERE r <= 3 GROUP BY 1)
SELECT section, 'sectionProperty' AS header, '' AS property, examples FROM s JOIN e ON section = c_mktsegment
UNION ALL SELECT section, h.header, h.property, NULL FROM s JOIN e ON section = c_mktsegment, (VALUES ('Order', 'orderNumber'), ('Status', ''), ('Total', 'total'), ('Priority', '')) h(header, property)
""")
def order_vocab(spark, sf_dir):
    """The template of a page for each customer with orders, sections by segment; one property by label, one by rule."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    pages = order_pages(spark, sf_dir).join(c, F.col("page_id") == F.col("c_custkey")).select("page_id", "resource", F.replace("html", F.lit(">Orders</span>"), F.concat(F.lit(">"), escaped(F.col("c_mktsegment")), F.lit("</span>"))).alias("html"))
    labels = spark.createDataFrame([(ONTOLOGY + "orderNumber", kb.LABEL, "order", "en"), (ONTOLOGY + "bestellung", kb.LABEL, "status", "de"), ("http://aa.example.org/x", kb.LABEL, "priority", "en")], "s string, p string, o string, lang string")
    return run.explore(pages, rule_frame(spark, ("loose", "Total", "total")), kb=labels)


@query("""
WITH c AS (SELECT replace(c_name, '#', '') AS section, c_custkey = (SELECT min(c_custkey) FROM customer) AS first FROM customer)
SELECT section, CASE WHEN first THEN section || '_tte_Customer' ELSE section END AS "group" FROM c
UNION ALL SELECT 'Customer', section || '_tte_Customer' FROM c WHERE first
""")
def hub_sections(spark, sf_dir):
    """A section that all others contain makes one component of them, and joins the group that was joined the longest ago."""
    c = table(spark, sf_dir, "customer")
    rows, head = F.lit("<tr><td>1</td></tr><tr><td>2</td></tr>"), head_html("A")
    half = c.agg(F.max("c_custkey")).first()[0] // 2
    hub = F.when(F.col("c_custkey") == half, table_html(rows, head, F.lit("Customer"))).otherwise("")
    pages = c.select(F.col("c_custkey").alias("page_id"), F.col("c_name").alias("resource"), F.concat(table_html(rows, head, F.col("c_name")), hub).alias("html"))
    return explore.section_vocabulary(parsed(pages, data=False), True, largest=1000).select("section", "group")


@query("""
SELECT section, 'sectionProperty' AS header, '' AS property, examples FROM (
  SELECT CASE WHEN k % 2 = 0 THEN 'Item_' || k || 'x_tte_Item_' || k || 'x_list' ELSE 'Entry_' || k || 'x' END AS section,
         CASE WHEN k % 2 = 0 THEN 'Part_' || k || ', Part_' || k || '__b' ELSE NULL END AS pages, 'Part_' || k AS examples
  FROM (SELECT p_partkey AS k FROM part))
UNION ALL SELECT CASE WHEN k % 2 = 0 THEN 'Item_' || k || 'x_tte_Item_' || k || 'x_list' ELSE 'Entry_' || k || 'x' END, 'A', '', NULL FROM (SELECT p_partkey AS k FROM part)
""")
def many_similar_sections(spark, sf_dir):
    """Two sections of each even part of which one contains the other, and one of each odd part: as many groups as parts."""
    block = lambda section: table_html(row_html(F.lit("1")), head_html("A"), section)
    key = F.col("p_partkey").cast("string")
    even = F.concat(block(F.concat(F.lit("Item "), key, F.lit("x"))), block(F.concat(F.lit("Item "), key, F.lit("x list"))))
    pages = part_pages(spark, sf_dir, F.when(F.col("p_partkey") % 2 == 0, even).otherwise(block(F.concat(F.lit("Entry "), key, F.lit("x")))))
    return run.explore(pages, rule_frame(spark, ("loose", "none", "none")), similar=True)


# ---------------------------------------------------------------- page statistics

# tags of the text without comments and scripts, counted by what lies between them
_SHOWN = r"regexp_replace(regexp_replace(regexp_replace(lower(html), '(?s)<!--.*?(-->|$)', ' ', 'g'), '(?s)<script[\s/>].*?(</script\s*>|$)', ' ', 'g'), '(?s)<style[\s/>].*?(</style\s*>|$)', ' ', 'g')"
_COUNT = f"CASE WHEN html IS NULL OR trim(html) = '' THEN 0 ELSE len(regexp_split_to_array({_SHOWN}, '<{{}}[\\s/>]')) - 1 END"


@query(f"SELECT page_id, CAST({_COUNT.format('li')} AS BIGINT) AS n, html IS NULL OR trim(html) = '' AS lost FROM pages")
def page_lists(spark, sf_dir):
    return stats.count_structures(table(spark, sf_dir, "pages"), "list")


@query(f"SELECT page_id, CAST({_COUNT.format('table')} AS BIGINT) AS n, html IS NULL OR trim(html) = '' AS lost FROM pages")
def page_tables(spark, sf_dir):
    return stats.count_structures(table(spark, sf_dir, "pages"), "table")


@query(f"SELECT page_id, CAST({_COUNT.format('li')} AS BIGINT) AS n, CAST(sum({_COUNT.format('li')}) OVER (ORDER BY page_id) AS BIGINT) AS total FROM pages")
def page_running_total(spark, sf_dir):
    return stats.running_total(stats.count_structures(table(spark, sf_dir, "pages"), "list"))


@query(f"SELECT count(*) AS pages, CAST(count_if(html IS NULL OR trim(html) = '') AS BIGINT) AS lost, CAST(sum({_COUNT.format('table')}) AS BIGINT) AS tables, CAST(sum({_COUNT.format('li')}) AS BIGINT) AS lists FROM pages")
def stats_total(spark, sf_dir):
    return stats.totals(table(spark, sf_dir, "pages"))


def odd_pages(spark, sf_dir):
    """A page for each part: lost in some way, or with tags in any case, and in comments and scripts."""
    k = F.col("p_partkey") % 6
    body = F.concat(F.lit("<TABLE\nclass='x'><tr><td>"), escaped(F.col("p_name")), F.lit("</TABLE><!-- <table> --><script>var t = '<table><li>';</script><ul><LI>a<li\tid='b'>b</ul><table/><link><tables>"))
    message = F.concat(F.lit("Error "), F.col("p_size").cast("string"), F.lit(": no page"))
    return part_pages(spark, sf_dir, F.when(k == 0, F.lit(None)).when(k == 1, F.lit("  ")).when(k == 2, message).otherwise(body))


@query("""
SELECT CASE p_partkey % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'empty' ELSE 'Error ' || p_size END AS reason, count(*) AS n, count(*) AS calls FROM part WHERE p_partkey % 6 < 3 GROUP BY 1
""")
def lost_pages(spark, sf_dir):
    """Lost pages by what came in their place."""
    return stats.lost_pages(odd_pages(spark, sf_dir))


@query("SELECT p_partkey AS page_id, CAST(CASE WHEN p_partkey % 6 < 3 THEN 0 ELSE 2 END AS BIGINT) AS tables, CAST(CASE WHEN p_partkey % 6 < 3 THEN 0 ELSE 2 END AS BIGINT) AS lists, CASE WHEN p_partkey % 6 < 3 THEN 'LOST' ELSE 'OK' END AS status FROM part")
def tags_in_any_case(spark, sf_dir):
    """Tables and list items of untidy pages."""
    pages = odd_pages(spark, sf_dir)
    both = stats.count_structures(pages, "table").select("page_id", F.col("n").alias("tables")).join(stats.count_structures(pages, "list").select("page_id", F.col("n").alias("lists")), "page_id")
    return both.join(with_status(pages).select("page_id", "status"), "page_id")


@query("SELECT o_custkey AS page_id, CAST(1 AS BIGINT) AS n, CAST(count(*) OVER (ORDER BY o_custkey) AS BIGINT) AS total FROM orders")
def repeated_running_total(spark, sf_dir):
    """A running total over ids that repeat: those of one id have one total."""
    return stats.running_total(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), F.lit(1).cast("long").alias("n")))


# ---------------------------------------------------------------- scalar functions


@query("""
SELECT p_partkey, replace(p_name, ' ', '_') AS resource, regexp_replace(p_name || '!?', '[[:punct:]]', '', 'g') AS bare, split_part('http://x/resource/' || replace(p_name, ' ', '_') || '/y', '/', 5) AS segment,
       replace(p_name, ' ', '+') || '%2A' AS plus, try_cast(p_retailprice::VARCHAR AS DOUBLE) AS number, false AS grouped, true AS whole
FROM part
""")
def text_functions(spark, sf_dir):
    """Scalar functions on part names."""
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        fn.resource_key(F.concat(F.lit(" "), name, F.lit(" "))).alias("resource"),
        fn.strip_punctuation(F.concat(name, F.lit("!?"))).alias("bare"),
        fn.segment_after(F.concat(F.lit("http://x/resource/"), fn.underscored(name), F.lit("/y"))).alias("segment"),
        fn.query_plus(F.concat(name, F.lit("*"))).alias("plus"),
        fn.to_float(F.col("p_retailprice").cast("string")).alias("number"),
        fn.is_float(F.lit("1,000")).alias("grouped"),
        fn.is_int(F.col("p_size").cast("string")).alias("whole"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y_%m_%d-%H_%M') AS minute, strftime(o_orderdate, '%Y_%m_%d') AS day FROM orders")
def date_stamps(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.date_time_stamp(F.col("o_orderdate")).alias("minute"), fn.date_stamp(F.col("o_orderdate")).alias("day"))


@query("SELECT doc_id, CAST(length(x) AS BIGINT) AS n, md5(x) AS digest FROM (SELECT doc_id, regexp_replace(strip_accents(coalesce(text, '')), '[^\\x00-\\x7F]', '', 'g') AS x FROM documents)")
def accents(spark, sf_dir):
    """Accents dropped in every whole text, as a digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", fn.plain_accents(F.coalesce("text", F.lit(""))).alias("x"))
    return docs.select("doc_id", F.length("x").cast("long").alias("n"), F.md5(F.col("x").cast("binary")).alias("digest"))


@query("SELECT DISTINCT p_type AS name, 'Citta_' || replace(p_type, ' ', '_') AS key FROM part")
def section_names(spark, sf_dir):
    """Names of sections as a template has them: no accents, blanks as underscores."""
    heads = table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.concat(F.lit("Città "), "p_type").alias("group"), F.lit("x").alias("examples"), F.struct(F.lit(1).alias("page_id")).alias("first")).distinct()
    made = explore.template(heads, spark.createDataFrame([], "group string, header string, property string"), rule_frame(spark, ("loose", "a", "b")).select("kind", "key", "property"))
    return made.select(F.replace(F.expr("substring(section, 7)"), F.lit("_"), F.lit(" ")).alias("name"), F.col("section").alias("key"))
