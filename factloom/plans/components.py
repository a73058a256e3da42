"""Connected components of an edge table, by alternating large-star and small-star steps.

All state stays in tables; a round is two aggregations and joins, and is written
to the shared folder, so that lineage ends with each round. The hub of a star
has as many edges as the star has nodes: these are dealt in pieces, so that no
task gathers them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.scratch import Scratch
from factloom.plans.skew import salted_join


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` (u, v) with m, the least v of u; ``total``: how many there are."""
    return salted_join(edges, edges.groupBy("u").agg(F.min("v").alias("m")), "u", F.col("v"), total)


def _large(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours, hung on the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = _with_least(both, 2 * total).where("v > u")
    return joined.select("v", F.least("u", "m").alias("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours, hung on the smallest of these; edges run from larger to smaller."""
    moved = _with_least(edges, total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(edges.groupBy("u").agg(F.min("v").alias("v")))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Edges with a null end and loops are left out: a node that has no others has
    no row. No edges, no rows.
    """
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not sums[0] or sums == seen:
            break
        large = scratch.save(_large(now, sums[0]).distinct(), "edges")
        after = scratch.save(_small(large, sums[0]).distinct(), "edges")
        scratch.drop(now)
        scratch.drop(large)
        now, seen = after, sums
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merge_components(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` (node, component) after more links (u, v); a node without a label is a component of its own.

    The links are taken to the components they join, and only these are solved.
    """
    ends, n = links, links.count()
    for c, other in (("u", "v"), ("v", "u")):
        own = labels.select(F.col("node").alias(c), F.col("component").alias("w"))
        ends = salted_join(ends, own, c, F.col(other), n, "left").select(F.coalesce("w", c).alias(c), other)
    moved = scratch.save(connected_components(ends, scratch), "moved")
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("now"))
    known = salted_join(labels, to, "component", F.col("node"), labels.count(), "left")
    fresh = moved.join(labels.select("node"), "node", "left_anti")
    return known.select("node", F.coalesce("now", "component").alias("component")).unionByName(fresh)
