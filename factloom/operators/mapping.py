"""Rows into triples, by rules that name a property for a section or a header.

Rules are a frame (chapter, kind, section, header, key, property); ``kind`` is
section, strict (section and header), loose (header alone) or any (the key may
be either). The rules of a
chapter are few, and Spark's own size check decides whether they are broadcast.
Sections without a rule are dropped before their cells are touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import is_float, is_int, plain_accents, resource_key
from factloom.plans.scratch import Scratch
from factloom.plans.skew import FEW_BYTES, lookup, salted_join, tasks

#: Parts of the tables whose rows are numbered, for each task of a shuffle.
PIECES = 4
XSD = "http://www.w3.org/2001/XMLSchema#"


@dataclass(frozen=True)
class Names:
    """Where addresses of resources and properties begin; every chapter but the main one has a host of its own."""

    host: str = "kb.example.org"
    main: str = "en"

    def resource(self, chapter: str) -> str:
        return f"http://{self.host}/resource/" if chapter == self.main else f"http://{chapter}.{self.host}/resource/"

    @property
    def ontology(self) -> str:
        return f"http://{self.host}/ontology/"

    @property
    def property(self) -> str:
        return f"http://{self.host}/property/"


def chapter_rules(rules: DataFrame, chapter: str, fallback: str | None = None) -> DataFrame:
    """(kind, key, property) of a chapter, one for each key; keys that only ``fallback`` has come from there."""
    rank = F.when(F.col("chapter") == chapter, 0).when(F.col("chapter") == F.lit(fallback), 1)
    found = rules.withColumn("rank", rank).where("rank is not null")
    return found.groupBy("kind", "key").agg(F.min(F.struct("rank", "property")).alias("best")).select("kind", "key", F.col("best.property").alias("property"))


def mapped_rows(rows: DataFrame, rules: DataFrame, base: str, numbered: DataFrame | None = None, links: bool = False) -> DataFrame:
    """Rows of tables whose section has a property, numbered from 1 within a resource, and their subject.

    ``rules``: of one chapter; ``base``: where addresses of resources begin. Only rows that stay take a number. The numbering
    is a sum over tables, not over rows; the rows are taken apart behind it.
    A page without a name is named by its id. ``links``: cells (header, value) have their first ``link`` too. ``numbered`` (resource, rows): how many rows of
    a resource have a number already, where others came before.
    """
    rows = rows.withColumn("resource", F.coalesce("resource", F.concat(F.lit("page_"), F.col("page_id").cast("string"))))
    sections = rules.where("kind = 'section' and property <> ''").select(F.expr("substring(key, 9)").alias("section"), F.col("property").alias("section_property"))
    # of a cell only what triples are made of goes through the shuffle
    cell = lambda c: F.struct(c["header"].alias("header"), c["value"].alias("value"), *([F.get(c["links"], F.lit(0)).alias("link")] if links else []))
    kept = F.transform(F.filter("rows", lambda r: ~r["removed"]), lambda r: F.transform(r["cells"], cell))
    subject = F.concat(F.lit(base), F.replace(plain_accents(F.col("resource")), F.lit("'"), F.lit("")))
    met = lookup(rows, sections, "section", F.concat_ws("\0", "page_id", "table_ord")).where("section_property is not null")  # which side is small is counted: by its files' bytes Spark may take the tables for it
    tables = met.select(subject.alias("subject"), "resource", "page_id", "table_ord", "section", "section_property", kept.alias("kept"))
    if not tables.isStreaming:  # tables carry all their cells: a task sorts a part of them
        tables = tables.repartition(PIECES * tasks(tables.sparkSession), "resource")
    place = Window.partitionBy("resource").orderBy("page_id", "table_ord").rowsBetween(Window.unboundedPreceding, -1)
    counted = tables.withColumn("before", F.coalesce(F.sum(F.size("kept")).over(place), F.lit(0)))
    if numbered is not None:
        counted = counted.join(numbered.select("resource", F.col("rows").alias("earlier")), "resource", "left").withColumn("before", F.col("before") + F.coalesce("earlier", F.lit(0)))
    each = counted.select("subject", "resource", "table_ord", "section", "section_property", "before", F.posexplode("kept").alias("at", "row"))
    return each.select("subject", "resource", "table_ord", "section", "section_property", (F.col("before") + F.col("at") + 1).alias("row_index"), F.col("row").alias("cells"))


def row_counts(rows: DataFrame, rules: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """(resource, rows): how many rows of each resource have a number, after those of ``numbered``; ``rules``: of one chapter."""
    last = mapped_rows(rows, rules, "", numbered).groupBy("resource").agg(F.max("row_index").alias("rows"))
    return last.select("resource", F.col("rows").cast("long").alias("rows"))


def with_property(cells: DataFrame, rules: DataFrame, by: Column, few_bytes: int = FEW_BYTES) -> DataFrame:
    """``cells`` (section, header) with ``property``: of the strict rule if there is one, even an empty one, else of the loose rule.

    A header may be that of most cells; ``by`` tells its cells apart where the rules are too many to be broadcast.
    """
    strict = rules.where("kind in ('strict', 'any')").select(F.col("key").alias("strict_key"), F.col("property").alias("strict_property"))
    loose = rules.where("kind in ('loose', 'any')").select(F.col("key").alias("header"), F.col("property").alias("loose_property"))
    found = lookup(cells.withColumn("strict_key", F.concat_ws("_", "section", "header")), strict, "strict_key", by, few_bytes)
    found = lookup(found, loose, "header", by, few_bytes)
    chosen = F.when(F.col("strict_property").isNotNull(), F.col("strict_property")).otherwise(F.col("loose_property"))
    return found.withColumn("property", chosen).drop("strict_key", "strict_property", "loose_property")


def literal_kind(value: Column) -> Column:
    """xsd:float for what reads as a number, xsd:int for what reads only as a whole number, else xsd:string."""
    return F.when(is_float(value), F.lit(XSD + "float")).when(is_int(value), F.lit(XSD + "int")).otherwise(F.lit(XSD + "string"))


def link_entities(cells: DataFrame, kb: DataFrame, base: str, is_text: Column, by: Column, value_col: str = "value", scratch: Scratch | None = None) -> DataFrame:
    """``cells`` with ``entity``: the address of a text that is a subject of ``kb`` (s, p, o), else null.

    By equality, of distinct texts; the answers come back to the cells, a text of
    many cells in pieces that ``by`` tells apart. The cells are a table meanwhile,
    in ``scratch`` if it is given, to be closed by who gives it.
    """
    key = resource_key(F.col(value_col))
    saved = (scratch or Scratch(cells.sparkSession, "cells")).save(cells.withColumn("_address", F.when(is_text, F.concat(F.lit(base), plain_accents(key)))), "cells")
    asked = saved.select("_address").where("_address is not null").distinct()
    known = asked.join(kb.select(F.col("s").alias("_address")).distinct(), "_address", "left_semi").withColumn("_known", F.lit(True))
    found = salted_join(saved, known, "_address", by, saved.count(), "left")
    return found.withColumn("entity", F.when(F.col("_known"), F.concat(F.lit(base), key))).drop("_address", "_known")


def make_triples(rows: DataFrame, rules: DataFrame, chapter: str = "en", kb: DataFrame | None = None, names: Names = Names(), fallback: str | None = None, prefer_link: bool = False, scratch: Scratch | None = None, numbered: DataFrame | None = None) -> DataFrame:
    """All triples (s, p, o, o_kind, datatype) of joined rows, each with ``kind`` row or cell, duplicates included.

    Empty cells (-) and cells without a property give none; a row gives its own
    triple even if no cell does. ``prefer_link`` maps a cell's first link rather
    than its text. Without a ``kb`` no text becomes an address. Rows and cells
    come from one pass: a row's own triple is a cell before its first.
    """
    own = chapter_rules(rules, chapter, fallback)
    base = names.resource(chapter)
    numbered = mapped_rows(rows, own, base, numbered, prefer_link).withColumn("row_of", F.concat("subject", F.lit("__"), F.col("row_index").cast("string")))
    each = numbered.select("subject", "row_of", "section", "section_property", F.explode(F.concat(F.array(F.lit(None)), "cells")).alias("cell"))
    apart = F.concat(F.lit("\0"), "row_of")  # no key; spreads rows over a join
    value = F.coalesce("cell.link", "cell.value") if prefer_link else F.col("cell.value")
    flat = each.select("subject", "row_of", "section", "section_property", F.col("cell").isNull().alias("own"), F.coalesce("cell.header", apart).alias("header"), value.alias("value"))
    found = with_property(flat, own, F.concat_ws("\0", "row_of", "value")).where("own or (value <> '-' and property <> '')")
    is_text = ~F.col("own") & ~is_float(F.col("value"))
    found = link_entities(found, kb, base, is_text, F.concat_ws("\0", "row_of", "header"), scratch=scratch) if kb is not None else found.withColumn("entity", F.lit(None).cast("string"))
    address = F.col("own") | F.col("entity").isNotNull()
    return found.select(
        F.when(F.col("own"), F.col("subject")).otherwise(F.col("row_of")).alias("s"),
        F.concat(F.lit(names.ontology), F.when(F.col("own"), F.col("section_property")).otherwise(F.col("property"))).alias("p"),
        F.when(F.col("own"), F.col("row_of")).otherwise(F.coalesce("entity", "value")).alias("o"),
        F.when(address, "iri").otherwise("literal").alias("o_kind"),
        F.when(~address, literal_kind(F.col("value"))).alias("datatype"),
        F.when(F.col("own"), "row").otherwise("cell").alias("kind"),
    )


def graph(triples: DataFrame) -> DataFrame:
    """The set of triples (s, p, o, o_kind, datatype)."""
    return triples.select("s", "p", "o", "o_kind", "datatype").distinct()
