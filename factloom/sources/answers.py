"""Answers of services as JSON texts: bindings of a query, yes or no, and structures of a page.

All is one parse inside the JVM, by a schema; an answer that is cut off, no JSON
or a message in place of a result has its status, and stops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TERM = "struct<type:string,value:string,datatype:string,`xml:lang`:string>"
_SCHEMA = f"results struct<bindings:array<map<string,{_TERM}>>>, boolean boolean, result array<variant>, message string, _bad string"


def parsed(answers: DataFrame, body: str = "body") -> DataFrame:
    """``answers`` with ``answer`` and ``status``: OK, MISSING, MALFORMED for what is no whole JSON, or ERROR for a message.

    Null and blank bodies are missing; a text that begins with Error, and an object without a result, are errors.
    """
    text = F.col(body)
    found = answers.withColumn("answer", F.from_json(text, _SCHEMA, {"columnNameOfCorruptRecord": "_bad"}))
    a = F.col("answer")
    nothing = a["results"].isNull() & a["boolean"].isNull() & a["result"].isNull()
    status = F.when(text.isNull() | (F.trim(text) == ""), "MISSING").when(F.ltrim(text).startswith("Error"), "ERROR").when(a.isNull() | a["_bad"].isNotNull(), "MALFORMED").when(nothing | a["message"].isNotNull(), "ERROR")
    return found.withColumn("status", F.coalesce(status, F.lit("OK")))


def bindings(answers: DataFrame, body: str = "body") -> DataFrame:
    """A row for each variable of each binding of good answers: the columns of ``answers``, place, variable, value, kind, datatype, lang."""
    good = parsed(answers, body).where("status = 'OK' and answer.results is not null")
    each = good.select(*(c for c in answers.columns if c != body), F.posexplode("answer.results.bindings").alias("place", "binding"))
    terms = each.select(*(c for c in each.columns if c != "binding"), F.explode("binding").alias("variable", "term"))
    return terms.select(*(c for c in terms.columns if c != "term"), "term.value", F.col("term.type").alias("kind"), "term.datatype", F.col("term")["xml:lang"].alias("lang"))


def of_variable(answers: DataFrame, variable: str, body: str = "body") -> DataFrame:
    """The distinct values of one variable over all good answers, as ``s``."""
    return bindings(answers, body).where(F.col("variable") == variable).select(F.col("value").alias("s")).distinct()


def counted(answers: DataFrame, variable: str = "res_num", body: str = "body") -> DataFrame:
    """``answers`` with ``n``: the number that the first binding gives to a variable; null where there is none."""
    found = parsed(answers, body)
    value = F.get(F.col("answer.results.bindings"), F.lit(0))[variable]["value"]
    return found.select(*answers.columns, "status", F.when(F.col("status") == "OK", value.try_cast("long")).alias("n"))


def confirmed(answers: DataFrame, body: str = "body") -> DataFrame:
    """``answers`` with ``known``: the yes or no of a good answer, else false."""
    return parsed(answers, body).select(*answers.columns, "status", F.coalesce((F.col("status") == "OK") & F.col("answer.boolean"), F.lit(False)).alias("known"))


def structures(answers: DataFrame, body: str = "body") -> DataFrame:
    """``answers`` with ``n``, the structures that a page's answer lists, none where it is lost, and ``lost``."""
    found = parsed(answers, body)
    good = (F.col("status") == "OK") & F.col("answer.result").isNotNull()
    return found.select(*answers.columns, "status", F.when(good, F.size("answer.result")).otherwise(0).cast("long").alias("n"), (~good).alias("lost"))
