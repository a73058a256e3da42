"""Jaccard join on word n-grams: candidates share prefix tokens under several token orders.

A document is the set of its distinct word shingles, as 64-bit hashes; equal sets
are one node. If two sets, of sizes n and m, have a similarity of at least r,
either lacks at most n - ceil(r n) = n - t tokens of the other, whatever the order of
all tokens. So of the first n - t + k tokens of a set at least k are in the
other (and k of the first m - t + k of the other, for the smaller k of the two). The
orders are

1. by hash, rising: nodes are kept with at least k tokens among their first
   n - t + k that some other node has among its own first ones;
2. by hash, falling, with a larger k, the same among those kept; who meets here is
   compared to a centre, so that a group of near copies is one component before
   pairs are made;
3. the rarest first among those that still share as much with another component:
   pairs of different components that share a token among the first n - t + 1, at
   places that leave room for the rest, and whose bitmaps don't differ too much.

A pair is a candidate if it passes all three; the first two are tested on the
sorted sets at hand, as slices from either end, before the sets are intersected
in full. Frequencies are counted anew among the nodes kept so far, so that each
order is sharper than it is over all. All filters are exact: no link is lost.

Most documents end at the first order, which sees a fifth and a little more of
each set: only theirs are the tokens that are shuffled for all documents. Hot
tokens are counted by partial sums and dealt in pieces where nodes meet; in a
bucket the nodes of its largest component never meet each other.

Defined results: null and empty texts, and texts without words, have an empty
set and no links; with fewer words than a shingle has, the whole sequence is
one; rows with a null id have no component; rows that share an id are one
document, linked if one of its texts is; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.minhash import WORDS, Sketcher, _near
from factloom.plans.arrow import map_rows
from factloom.plans.components import connected_components, merge_components
from factloom.plans.scratch import Scratch
from factloom.plans.skew import salted_join, sized

#: Tokens looked at beyond the shortest prefix, as a share of it, by the first order and the second: they ask for as many more in common.
FIRST, SECOND = 0.15, 0.6
#: Centres that a node is compared to at most, those that it shares most tokens with; what they miss, the third order finds.
CENTRES = 3


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n tokens with one that is similar enough."""
    return -(-n * percent // 100)


def _slack(n: Column, percent: int) -> Column:
    return (n - F.ceil(n * percent / F.lit(100))).cast("int")


def _more(n: Column, percent: int, share: float) -> Column:
    """The tokens that similar sets of n have in common at least, in prefixes that are longer by ``share``."""
    return (F.ceil(_slack(n, percent) * F.lit(share)) + 1).cast("int")


def _length(n: Column, percent: int, share: float) -> Column:
    """The tokens of such a prefix."""
    return F.least(_slack(n, percent) + _more(n, percent, share), n.cast("int"))


def _shared(n: Column, percent: int, share: float) -> Column:
    """How many of them the prefix of any similar set has at least: the smallest such set asks for the fewest."""
    return _more(F.ceil(n * percent / F.lit(100)), percent, share)


def heads(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Rows (id, n, set_hash, head) of rows (id, text): the first tokens by hash; null hash and head where the set is empty."""
    schema = T.StructType(
        [T.StructField("id", docs.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("set_hash", T.BinaryType()), T.StructField("head", T.ArrayType(T.LongType()))]
    )

    def make():
        tool = Sketcher(shingle, 1, 1)

        def first(x: np.ndarray) -> np.ndarray:
            slack = len(x) - needed(len(x), percent)
            return x[: slack + math.ceil(slack * FIRST) + 1].view(np.int64)

        def work(ids, texts):
            sets = [tool.shingles(x or "") for x in texts]
            return {
                "id": ids,
                "n": [len(x) for x in sets],
                "set_hash": [tool.digest(x.tobytes()) if len(x) else None for x in sets],
                "head": pa.array([first(x) if len(x) else None for x in sets], pa.list_(pa.int64())),
            }

        return work

    return map_rows(docs.select("id", "text"), make, schema)


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows (node, n, which, bits, shingles) of rows (node, text) with a set: its hash, a bitmap in which each token turns over one bit, its sorted tokens."""
    kinds = (("n", T.LongType()), ("which", T.LongType()), ("bits", T.ArrayType(T.LongType())), ("shingles", T.ArrayType(T.LongType())))
    schema = T.StructType([T.StructField("node", docs.schema["node"].dataType)] + [T.StructField(k, t) for k, t in kinds])

    def make():
        tool = Sketcher(shingle, 1, 1)

        def work(nodes, texts):
            sets = [tool.shingles(x or "") for x in texts]
            return {
                "node": nodes,
                "n": [len(x) for x in sets],
                "which": [int.from_bytes(tool.digest(x.tobytes())[:8], "little", signed=True) for x in sets],
                "bits": [tool.bitmap(x) if len(x) else [0] * WORDS for x in sets],
                "shingles": pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
            }

        return work

    return map_rows(docs.select("node", "text"), make, schema).where("n > 0")


def _common(prefixes: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of (prefix, and others) for each token that more than one prefix has, with token and f, how many have it, in place of the prefix.

    A token of more than one part in 1024 of all is found by a broadcast of fewer than 1024 such.
    """
    total = prefixes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    posted = prefixes.withColumn("token", F.explode("prefix")).drop("prefix")
    counts = scratch.save(posted.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "counts")
    heavy = F.col("f") > F.lit(total / 1024)
    marked = posted.join(F.broadcast(counts.where(heavy)), "token", "left")
    rest = marked.where("f is null").drop("f").join(counts.where(~heavy), "token")
    return marked.where("f is not null").unionByName(rest)


def _keeping(common: DataFrame, sizes: DataFrame, percent: int, share: float) -> DataFrame:
    """The nodes of which enough tokens are common; ``sizes``: (node, n)."""
    hits = common.groupBy("node").agg(F.count(F.lit(1)).alias("hits")).join(sizes, "node")
    return hits.where(F.col("hits") >= _shared(F.col("n"), percent, share)).select("node").distinct()


def _still_apart(common: DataFrame, labels: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The nodes that have enough tokens in common with other components."""
    own = scratch.save(common.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "own")
    mixed = own.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    met = salted_join(own.select("token", "node", "n"), mixed, "token", F.col("node"), own.count())
    hits = met.groupBy("node").agg(F.count(F.lit(1)).alias("hits"), F.min("n").alias("n"))
    return scratch.save(hits.where(F.col("hits") >= _shared(F.col("n"), percent, SECOND)).select("node"), "apart")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Of the distinct pairs (a, b) the links (u, v), as a table: those that share prefix tokens from either end of the sorted sets, then those whose full sets are similar enough."""
    pairs = scratch.save(pairs, "pairs")
    side = lambda i: sets.select(F.col("node").alias(i), F.col("n").alias(f"n{i}"), F.col("shingles").alias(f"s{i}"))
    total = pairs.count()
    both = salted_join(salted_join(pairs, side("a"), "a", F.col("b"), total), side("b"), "b", F.col("a"), total)
    short = lambda i: (F.col(f"n{i}") - F.ceil(F.col(f"n{i}") * percent / F.lit(100)) + 1).cast("int")
    rising = F.arrays_overlap(F.slice("sa", F.lit(1), short("a")), F.slice("sb", F.lit(1), short("b")))
    falling = F.arrays_overlap(F.slice("sa", -short("a"), short("a")), F.slice("sb", -short("b"), short("b")))
    met = F.size(F.array_intersect("sa", "sb")).cast("long")
    candidates = both.where(rising & falling).withColumn("met", met)
    links = candidates.where(100 * F.col("met") >= percent * (F.col("na") + F.col("nb") - F.col("met")))
    found = scratch.save(links.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "links")
    scratch.drop(pairs)
    return found


def _to_centres(common: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each node and the few centres that it shares most tokens with.

    The centre of a token is the node whose tokens most others have: the page that
    others are copies of has no token of its own, as they have.
    """
    typical = common.groupBy("node").agg((F.sum("f") / _length(F.min("n"), percent, SECOND)).alias("weight"))
    known = common.join(typical, "node")
    best = F.max(F.struct(F.col("weight"), (-F.col("node")).alias("order"), F.col("n")))
    centre = known.groupBy("token").agg(best.alias("x")).select("token", (-F.col("x.order")).alias("a"), F.col("x.n").alias("na"))
    met = salted_join(common.select("token", F.col("node").alias("b"), "n"), centre, "token", F.col("b"), common.count())
    near = met.where((F.col("a") != F.col("b")) & (100 * F.least("n", "na") >= percent * F.greatest("n", "na")))
    shared = near.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    few = shared.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "a")), False), 1, CENTRES).alias("x"))
    return few.select(F.explode("x.a").alias("a"), "b")


def _by_rarest(sets: DataFrame, labels: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that share a prefix token where the rarest come first.

    Tokens of one node alone come before all others, and are no keys. Shared at
    place i of x and j of y, what follows must suffice for the overlap; and the bitmaps
    must not differ in more bits than similar sets can in tokens.
    """
    whole = [c for c in ("node", "n", "which") if c in sets.columns]
    each = scratch.save(sets.select(*whole, F.explode("shingles").alias("token")), "tokens")
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    ranked = salted_join(each, counts, "token", F.col("node"), each.count()).groupBy(*whole).agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("x"))
    lone = F.col("n") - F.size("x")
    first = (_slack(F.col("n"), percent) + 1 - lone).cast("int")
    places = ranked.select(*whole, lone.alias("lone"), F.posexplode(F.slice("x", F.lit(1), F.greatest(first, F.lit(0)))).alias("at", "t"))
    keyed = places.select(*whole, (F.col("lone") + F.col("at")).alias("at"), F.col("t.token").alias("token"))
    keyed = scratch.save(keyed.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "keyed")
    # a bucket's largest component, and the buckets that hold another
    part = keyed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
    most = part.groupBy("token").agg(F.max_by("component", F.struct("c", "component")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("token", "most")
    mixed = salted_join(keyed, most, "token", F.col("node"), keyed.count())
    mixed = scratch.save(mixed.join(sets.select(*whole, "bits"), whole), "mixed")
    names = ("node", "n", "at", "bits", "component")
    others = mixed.where("component <> most").select("token", *(F.col(c).alias(f"{c}_a") for c in names))
    met = salted_join(mixed, others, "token", F.col("node"), mixed.count()).where("component <> component_a")
    # two that are neither of the largest meet once
    met = met.where((F.col("component") == F.col("most")) | (F.col("node") < F.col("node_a")))
    need = F.ceil((F.col("n") + F.col("n_a")) * percent / F.lit(100 + percent))
    room = F.least(F.col("n") - F.col("at"), F.col("n_a") - F.col("at_a")) >= need
    return met.where(room & _near(percent)).select(F.least("node", "node_a").alias("a"), F.greatest("node", "node_a").alias("b")).distinct()


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``df``: id, n_shingles, component_id, the smallest id reachable over links.

    ``percent``: documents are linked from this Jaccard similarity of their shingle sets on.
    """
    scratch = Scratch(df.sparkSession, "ngrams")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = scratch.save(heads(docs, shingle, percent), "heads")
    with_set = sketches.where("id is not null and set_hash is not null")
    classes = scratch.save(with_set.groupBy("set_hash").agg(F.min("id").alias("node")), "classes")
    again = scratch.save(with_set.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi")).where("rows > 1"), "again")
    repeated = not again.isEmpty()
    nodes = with_set.join(classes.select("set_hash", F.col("node").alias("id")), ["id", "set_hash"], "left_semi").select(F.col("id").alias("node"), "n", F.col("head").alias("prefix"))
    nodes = nodes.distinct() if repeated else nodes

    # the first order
    sizes = nodes.groupBy("node").agg(F.min("n").alias("n")) if repeated else nodes.select("node", "n")
    kept = scratch.save(_keeping(_common(nodes.select("node", "prefix"), scratch), sizes, percent, FIRST), "kept")
    wanted = sized(scratch.save(kept.select(F.col("node").alias("id")), "wanted"))
    first = full_sets(docs.join(wanted, "id", "left_semi").select(F.col("id").alias("node"), "text"), shingle)
    first = scratch.save(first.distinct() if repeated else first.drop("which"), "sets")

    # the second, among those kept by the first
    long = _length(F.col("n"), percent, SECOND)
    common = scratch.save(_common(first.select(*(c for c in first.columns if c not in ("shingles", "bits")), F.slice("shingles", -long, long).alias("prefix")), scratch), "common")
    sizes = first.groupBy("node").agg(F.min("n").alias("n")) if repeated else first.select("node", "n")
    kept = scratch.save(_keeping(common, sizes, percent, SECOND), "kept")
    sets = scratch.save(first.join(sized(kept), "node", "left_semi"), "sets")
    scratch.drop(first)
    common = scratch.save(common.join(sized(kept), "node", "left_semi"), "common")
    links = _confirmed(_to_centres(common, percent), sets, percent, scratch)
    by_id = with_set.join(again.where("lo <> hi").select("id"), "id", "left_semi").join(classes, "set_hash").where("node <> id").select(F.col("id").alias("u"), F.col("node").alias("v"))
    labels = scratch.save(connected_components(links.unionByName(by_id), scratch), "labels")

    # the third, of what is still apart
    apart = _still_apart(common, labels, percent, scratch)
    links = _confirmed(_by_rarest(sets.join(sized(apart), "node", "left_semi"), labels, percent, scratch), sets, percent, scratch)
    if not links.isEmpty():
        labels = scratch.save(merge_components(labels, links, scratch), "labels")

    scratch.clear(sketches, classes, labels)  # all that the result reads
    of_class = classes.join(labels, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component"))
    found = salted_join(sketches.select("id", "n", "set_hash"), of_class, "set_hash", F.monotonically_increasing_id(), sketches.count(), "left")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def op13_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Groups of documents that are linked at a Jaccard similarity of 0.8 on five-word shingles."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs that share a shingle, and what is reachable over those alike: for small tables, as groups are squared.
OP13_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS g FROM words
), each AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS x FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(node, root) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT e.v, r.root FROM reach r JOIN edges e ON e.u = r.node
), least AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM sets JOIN least ON node = doc_id
"""
