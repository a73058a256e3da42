"""The rule base: parsing of filled-in templates, checks, upserts and storage.

A template is a frame (section, header, property), ``header`` being
``sectionProperty`` for the property of the section itself. Sections that were
grouped are joined by ``_tte_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import last_segment, strip_punctuation

#: Fixed values of the template's format.
SECTION_PREFIX, SECTION_PROPERTY, SEPARATOR = "SECTION_", "sectionProperty", "_tte_"
RULES = "chapter string, kind string, section string, header string, key string, property string"


def rules_from_dict(spark: SparkSession, given: dict[str, str], chapter: str) -> DataFrame:
    """Rules of a plain dictionary of keys to properties; only a section's key tells its kind."""
    kind = lambda key: "section" if key.startswith(SECTION_PREFIX) else "any"
    return spark.createDataFrame([(chapter, kind(k), None, None, k, v) for k, v in given.items()], RULES)


def parse_rules(template: DataFrame, chapter: str, output_format: int = 1) -> DataFrame:
    """Rules of a template: format 1 gives strict rules, format 2 rules by header alone.

    Punctuation and blanks are no part of a property; an empty header gives no
    rule; an empty property stays, as it deletes.
    """
    prop = F.replace(strip_punctuation(F.coalesce("property", F.lit(""))), F.lit(" "), F.lit(""))
    each = template.select(F.explode(F.split("section", SEPARATOR)).alias("raw"), "header", prop.alias("property"))
    each = each.select(F.replace("raw", F.lit("_"), F.lit(" ")).alias("section"), "header", "property").where("header <> ''")
    own = F.col("header") == SECTION_PROPERTY
    kind = F.when(own, "section").when(F.lit(output_format == 2), "loose").otherwise("strict")
    key = F.when(own, F.concat(F.lit(SECTION_PREFIX), "section")).when(F.lit(output_format == 2), F.col("header")).otherwise(F.concat_ws("_", "section", "header"))
    found = each.select(F.lit(chapter).alias("chapter"), kind.alias("kind"), "section", F.when(~own, F.col("header")).alias("header"), key.alias("key"), "property")
    return found.groupBy("chapter", "kind", "key").agg(F.max(F.struct("property", "section", "header")).alias("x")).select("chapter", "kind", "x.section", "x.header", "key", "x.property")


def check_ontology(rules: DataFrame, kb: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules whose property is one in ``kb`` (or empty), and those whose isn't."""
    known = kb.where(F.col("o").endswith("Property")).select(last_segment(F.col("s")).alias("property")).distinct()
    stated = rules.where("property <> ''")
    return stated.join(known, "property", "left_semi").unionByName(rules.where("property = ''")).select(*rules.columns), stated.join(known, "property", "left_anti").select(*rules.columns)


def upsert_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with ``new``: a property replaces or adds a rule, an empty one deletes it."""
    keys = ["chapter", "kind", "key"]
    before, after = old.select(*keys, F.struct("section", "header", "property").alias("a")), new.select(*keys, F.struct("section", "header", "property").alias("b"))
    both = before.join(after, keys, "full_outer").withColumn("x", F.coalesce("b", "a"))
    return both.where("x.property <> ''").select("chapter", "kind", "x.section", "x.header", "key", "x.property")


def write_rules(rules: DataFrame, folder: str, version: str) -> str:
    """Write a version of the rule base; what is being read is never overwritten. Returns its path."""
    path = f"{folder.rstrip('/')}/version={version}"
    rules.select("chapter", "kind", "section", "header", "key", "property").write.mode("errorifexists").json(path)
    return path


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULES).json(path)


def update_rules(old: DataFrame, template: DataFrame, chapter: str, output_format: int = 1, kb: DataFrame | None = None) -> DataFrame:
    """Parse, check against ``kb`` if one is given, and upsert."""
    new = parse_rules(template, chapter, output_format)
    return upsert_rules(old, check_ontology(new, kb)[0] if kb is not None else new)
