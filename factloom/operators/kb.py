"""A store of triples (s, p, o, optionally lang) as the source of resources and properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import last_segment, segment_after
from factloom.operators.patterns import TYPE, match_patterns

LABEL = "http://www.w3.org/2000/01/rdf-schema#label"


def of_class(triples: DataFrame, class_iri: str) -> DataFrame:
    """Subjects of any predicate whose object is the class."""
    return triples.where(F.col("o") == class_iri).select("s").distinct()


def count_resources(subjects: DataFrame) -> DataFrame:
    """The number of distinct subjects, as ``res_num``."""
    return subjects.agg(F.countDistinct("s").alias("res_num"))


def resource_names(subjects: DataFrame) -> DataFrame:
    """Distinct names: the path segment after ``resource``; subjects without it are left out."""
    return subjects.where(F.col("s").contains("resource")).select(segment_after(F.col("s")).alias("resource")).where("resource is not null").distinct()


def resource_page(subjects: DataFrame, size: int, offset: int) -> DataFrame:
    """One page of the distinct subjects in order."""
    return subjects.select("s").distinct().orderBy("s").offset(offset).limit(size)


def exists_in(frame: DataFrame, kb: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is a subject of ``kb``."""
    return frame.join(kb.select(F.col("s").alias(column)).distinct(), column, "left_semi")


def class_exists(kb: DataFrame, class_iri: str) -> bool:
    """Whether the class is a subject of ``kb``."""
    return not kb.where(F.col("s") == class_iri).isEmpty()


def known_classes(classes: DataFrame, kb: DataFrame) -> DataFrame:
    """``classes`` (s) with ``known``: whether each is a subject of ``kb``."""
    subjects = kb.select("s").distinct().withColumn("known", F.lit(True))
    return classes.join(subjects, "s", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def property_by_label(headers: DataFrame, kb: DataFrame, lang: str, word: str = "ontology", limit: int = 10) -> DataFrame:
    """(header, property): of the first ``limit`` subjects labelled as the header, as written or in lower case, the first of an address with ``word``."""
    labels = kb.where((F.col("p") == LABEL) & (F.col("lang") == lang)).select("s", F.col("o").alias("label"))
    asked = headers.select("header").distinct()
    forms = asked.select("header", F.col("header").alias("label"), F.lit(0).alias("form")).unionByName(asked.where(F.lower("header") != F.col("header")).select("header", F.lower("header").alias("label"), F.lit(1).alias("form")))
    order = Window.partitionBy("header").orderBy("form", "s")
    hits = forms.join(labels, "label").withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).where(F.col("s").contains(word))
    return hits.groupBy("header").agg(F.min_by("s", "n").alias("s")).select("header", last_segment(F.col("s")).alias("property"))


#: Patterns of common topics, {o} being where properties begin. Fixed values.
TOPICS = {
    "soccer": "?s a <{o}SoccerPlayer> . ?s <{o}wikiPageID> ?f",
    "act": "?s a <{o}Actor> . ?s <{o}wikiPageID> ?f",
    "dir": "?film a <{o}Film> . ?film <{o}director> ?s . ?s <{o}wikiPageID> ?f",
    "writer": "?s a <{o}Writer> . ?s <{o}wikiPageID> ?f",
    "all": "?s <{o}wikiPageID> ?f",
}


def topic_subjects(triples: DataFrame, topic: str, ontology: str) -> DataFrame:
    """Distinct subjects of a named topic, or of any other text as a pattern over ``?s``."""
    where = TOPICS[topic].format(o=ontology) if topic in TOPICS else topic
    return match_patterns(triples, where).select("s").distinct()
