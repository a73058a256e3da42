"""Reading triples: N-Triples, and Turtle with prefixes, lists of properties and lists of objects.

A file is read in ranges whose records are statements, up to a point at a line's
end, so that a statement over the edge of a range is read once. Statements are taken apart
inside the JVM: into tokens by a pattern, and these by a fold that knows which
term comes next. What can't be read is a row with ``error``, and no triple.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.patterns import TYPE

#: A term or mark of a statement. Literals take one line, as both forms write them, and are matched without going back, however long.
_TOKEN = r'(<[^<>"{}|^`\\\x00-\x20]*>|"(?:[^"\\\n]|\\.)*+"(?:\^\^<[^<>\s]*>|\^\^[\w-]*:[\w.-]*|@[A-Za-z0-9-]+)?|[;,]|_:[\w-]+|[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[\w-]*:(?:[\w-]|\.(?=[\w-]))*|\b(?:a|true|false)\b)'
_COMMENT = r"(?m)^\s*#.*$"
_PREFIX = r"^\s*@?(?i:prefix)\s+([\w-]*):\s*<([^>]*)>\s*$"
_XSD = "http://www.w3.org/2001/XMLSchema#"


def _plain(text: Column) -> Column:
    """A quoted text without its quotes and escapes."""
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    unescaped = F.from_json(F.concat(F.lit('{"x":"'), F.replace(inner, F.lit("\\'"), F.lit("'")), F.lit('"}')), "x string")["x"]
    return F.when(inner.contains("\\"), unescaped).otherwise(inner)


def _address(token: Column, prefixes: dict[str, str]) -> Column:
    """An address in brackets, or a name of which the prefix is known; null for others."""
    known = F.create_map(*(F.lit(x) for pair in (prefixes or {"\0": ""}).items() for x in pair))
    base = F.try_element_at(known, F.substring_index(token, ":", 1))
    named = F.concat(base, F.regexp_replace(token, r"^[\w-]*:", ""))
    return F.when(token.startswith("<"), F.substring(token, F.lit(2), F.length(token) - 2)).when(token.startswith("_:"), token).when(token == "a", TYPE).otherwise(named)


def statements(spark: SparkSession, path: str, holds: Column | None = None) -> DataFrame:
    """The statements of the files, without comments and points, as ``value``; ``holds``: only of records, as they are read, for which this is true."""
    lines = spark.read.option("lineSep", ".\n").text(path)
    lines = lines if holds is None else lines.where(holds)
    plain = F.when(F.col("value").contains("#"), F.regexp_replace("value", _COMMENT, "")).otherwise(F.col("value"))
    ends = F.rtrim(F.col("value"), F.lit(" \t\n\r\f\x0b")).endswith(".")
    whole = lines.select(plain.alias("value")).select(F.trim(F.when(ends, F.regexp_replace("value", r"\.\s*\z", "")).otherwise(F.col("value"))).alias("value"))
    return whole.where("value rlike '\\\\S'")


def read_triples(spark: SparkSession, path: str, predicates: list[str] | None = None) -> DataFrame:
    """The triples (s, p, o, o_kind, datatype, lang, error) of N-Triples or Turtle files.

    ``predicates``: only triples with one of these addresses; of statements that
    don't name one, and no prefix, the scan keeps nothing. A statement that can't
    be read is a row with its text as ``error`` and nulls besides.
    """
    heads = statements(spark, path, F.lower("value").contains("prefix")).where(F.col("value").rlike(_PREFIX))
    prefixes = {r.name: r.base for r in heads.select(F.regexp_extract("value", _PREFIX, 1).alias("name"), F.regexp_extract("value", _PREFIX, 2).alias("base")).distinct().collect()}
    few = predicates is not None and not prefixes
    named = functools.reduce(lambda a, b: a | b, (F.col("value").contains(f"<{x}>") for x in predicates), F.lit(False)) if few else None
    asked = statements(spark, path, named).where(~F.col("value").rlike(_PREFIX))
    if few:
        asked = asked.where(F.arrays_overlap(F.regexp_extract_all("value", F.lit("<([^>]*)>"), F.lit(1)), F.lit(predicates)))
    tokens = F.regexp_extract_all("value", F.lit(_TOKEN), F.lit(1))
    rest = F.trim(F.regexp_replace(F.regexp_replace("value", _TOKEN, ""), r"\s+", ""))

    def step(state: Column, token: Column) -> Column:
        """Place 0 takes a subject, 1 a property, 2 an object, and 3 a mark."""
        place = state["place"]
        mark = token.isin(";", ",")
        after = F.when(mark & (place == 3), F.when(token == ";", 1).otherwise(2)).when(mark & (place == 1) & (token == ";"), 1).when(mark | (place == 3), -1).when(place < 0, -1).otherwise(place + 1)
        found = F.when(~mark & (place == 2), F.concat(state["found"], F.array(F.struct(state["s"].alias("s"), state["p"].alias("p"), token.alias("o"))))).otherwise(state["found"])
        return F.struct(after.cast("int").alias("place"), F.when(place == 0, token).otherwise(state["s"]).alias("s"), F.when(~mark & (place == 1), token).otherwise(state["p"]).alias("p"), found.alias("found"))

    start = F.struct(F.lit(0).alias("place"), F.lit("").alias("s"), F.lit("").alias("p"), F.array().cast("array<struct<s:string,p:string,o:string>>").alias("found"))
    whole = asked.select("value", (rest != "").alias("odd"), F.aggregate(tokens, start, step).alias("x"))
    good = ~F.col("odd") & ((F.col("x.place") == 3) | ((F.col("x.place") == 1) & (F.size("x.found") > 0)))
    none = F.array(F.struct(*(F.lit(None).cast("string").alias(c) for c in "spo")))
    each = whole.select("value", F.explode(F.when(good, F.col("x.found")).otherwise(none)).alias("t"))
    s, p, o = (F.col(f"t.{c}") for c in "spo")
    literal = o.startswith('"')
    number = o.rlike(r"^[+-]?[0-9]")
    truth = o.isin("true", "false")
    quoted = F.regexp_extract(o, r'^("(?:[^"\\]|\\.)*+")', 1)
    kind = F.regexp_extract(o, r'^"(?:[^"\\]|\\.)*+"\^\^(\S+)$', 1)
    of_number = F.when(o.rlike("[eE]"), "double").when(o.contains("."), "decimal").otherwise("integer")
    triples = each.select(
        _address(s, prefixes).alias("s"),
        _address(p, prefixes).alias("p"),
        F.when(literal, _plain(quoted)).when(number | truth, o).otherwise(_address(o, prefixes)).alias("o"),
        F.when(literal | number | truth, "literal").otherwise("iri").alias("o_kind"),
        F.when(literal & (kind != ""), _address(kind, prefixes)).when(number, F.concat(F.lit(_XSD), of_number)).when(truth, _XSD + "boolean").alias("datatype"),
        F.when(literal, F.nullif(F.regexp_extract(o, r'^"(?:[^"\\]|\\.)*+"@([A-Za-z0-9-]+)$', 1), F.lit(""))).alias("lang"),
        "value",
    )
    bad = F.col("s").isNull() | F.col("p").isNull() | F.col("o").isNull() | F.col("s").startswith('"')
    names = ("s", "p", "o", "o_kind", "datatype", "lang")
    found = triples.select(*(F.when(~bad, F.col(c)).alias(c) for c in names), F.when(bad, F.col("value")).alias("error"))
    return found if predicates is None else found.where(F.col("p").isin(predicates))
