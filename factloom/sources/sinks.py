"""Sinks: triples as N-Triples or Turtle, resource lists, templates and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.scratch import Scratch
from factloom.sources.commit import commit_lines

#: Objects of a block of Turtle at most.
OBJECTS = 1000


def _escaped(text: Column) -> Column:
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _address(text: Column) -> Column:
    """An address in brackets; characters that it can't hold are encoded."""
    return F.concat(F.lit("<"), F.regexp_replace(F.regexp_replace(text, " ", "_"), r'[<>"{}|\\^`\x00-\x1f]', "_"), F.lit(">"))


def _object() -> Column:
    literal = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), F.coalesce(F.concat(F.lit("^^"), _address(F.col("datatype"))), F.lit("")))
    return F.when(F.col("o_kind") == "iri", _address(F.col("o"))).otherwise(literal)


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """A line for each triple, as ``value``."""
    return triples.select(F.concat_ws(" ", _address(F.col("s")), _address(F.col("p")), _object(), F.lit(".")).alias("value"))


def turtle_blocks(triples: DataFrame, most: int = OBJECTS) -> DataFrame:
    """A block for each subject and property, with its objects in order, as ``value``; of many objects some blocks."""
    lines = triples.select("s", "p", _object().alias("x"))
    blocks = lines.groupBy("s", "p").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).alias("blocks")).where("blocks > 1")
    cut = lines.join(blocks, ["s", "p"], "left").withColumn("block", F.pmod(F.xxhash64("x"), F.coalesce("blocks", F.lit(1))))
    objects = cut.groupBy("s", "p", "block").agg(F.array_join(F.array_sort(F.collect_set("x")), ",\n        ").alias("x"))
    return objects.select(F.concat(_address(F.col("s")), F.lit(" "), _address(F.col("p")), F.lit(" "), "x", F.lit(" .")).alias("value"))


def write_graph(triples: DataFrame, path: str, form: str = "ntriples", run: str | None = None) -> bool:
    """Write a graph; an empty one is not written. Returns whether it was. With ``run`` it is committed as that run below ``path``."""
    scratch = Scratch(triples.sparkSession, "graph")
    if form == "turtle":  # blocks read the graph twice, and whether there is any asks for all of it: it is made once
        triples = scratch.save(triples, "graph")
    if triples.isEmpty():
        scratch.close()
        return False
    lines = {"ntriples": ntriples_lines, "turtle": turtle_blocks}[form](triples)
    if run is None:
        lines.write.mode("errorifexists").text(path)
    else:
        commit_lines(lines, path, run)
    scratch.close()
    return True


def write_resources(names: DataFrame, path: str) -> None:
    names.select(F.col("resource").alias("value")).write.mode("errorifexists").text(path)


def write_template(template: DataFrame, path: str, **heading: str) -> None:
    """A template as JSON, with what it was made for (topic, chapter, and so on) in each row."""
    for name, value in heading.items():
        template = template.withColumn(name, F.lit(value))
    template.write.mode("errorifexists").json(path)


def read_template(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """A written template (section, header, property), and what it was made for."""
    rows = spark.read.json(path)
    own = [c for c in rows.columns if c not in ("section", "header", "property", "examples")]
    first = rows.select(*own).first() if own else None
    return rows.select("section", "header", "property"), first.asDict() if first else {}


def write_report(report: DataFrame, path: str, run: str | None = None) -> None:
    """Write a report as JSON, with ``run`` as that run below ``path``."""
    if run is None:
        report.write.mode("errorifexists").json(path)
    else:
        commit_lines(report.select(F.to_json(F.struct("*")).alias("value")), path, run)
