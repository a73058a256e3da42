"""Near-duplicate groups: circulant MinHash, banding, and exact verification.

A document is the set of its distinct word shingles, as 64-bit hashes. Two
random permutations of one domain make all coordinates of its signature: the
first scatters the shingles, the second, shifted circularly by k, gives
coordinate k. Coordinates in bands are the keys under which documents meet.

Documents with equal sets are one node. In each bucket of a band the nodes are
compared to a centre, not all to each other: first to one, then, where a bucket
holds nodes of different components, to some chosen by hash. So a bucket of many
copies costs a multiple of its size. What is still apart in one bucket meets
under its rarest shingles: of two sets that are similar enough one of the
rarest of the smaller is among the rarest of the larger (prefix filter), at
places that leave room for the rest. So pages of one template, which share most
bands and have no link, meet only where they share what is rare among them.

Each node carries a bitmap of its set. Two bitmaps differ in no more bits than
the sets do in shingles, so that the join itself leaves out, exactly, pairs that
are too far apart. Links count only if the full sets confirm them, by integers.
With 40 bands of 5 a pair at the threshold of 0.8 meets in none with a
probability of 1.3e-7; the later steps lose nothing. Hot keys are dealt in
pieces.

Defined results: null and empty texts, and texts without words, have an empty
set and no links; with fewer words than a shingle has, the whole sequence is
one; rows with a null id have no component and are kept; rows that share an id
are one document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.plans.components import connected_components, merge_components
from factloom.plans.arrow import map_rows
from factloom.plans.scratch import Scratch
from factloom.plans.skew import salted_join, sized

BANDS, ROWS, DOMAIN, SEED = 40, 5, 1 << 20, 20240229
#: 64-bit words of a bitmap.
WORDS = 16
#: Centres of a bucket in the second round.
CENTRES = 8
_PART = 512
_U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class Sketcher:
    """Shingle sets, signatures and band keys of texts."""

    def __init__(self, shingle: int, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> None:
        import xxhash

        self.word = xxhash.xxh3_64_intdigest
        self.digest = xxhash.xxh3_128_digest
        rng = np.random.default_rng(seed)
        self.shingle, self.bands, self.rows, self.k = shingle, bands, rows, bands * rows
        self.scatter = rng.permutation(DOMAIN).astype(np.int32)
        values = rng.permutation(DOMAIN).astype(np.uint32)
        ring = np.concatenate([values[-self.k :], values])
        self.shifted = np.lib.stride_tricks.sliding_window_view(ring, self.k)
        odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * _U64(2) + _U64(1)
        self.weights, self.row_weights, self.band_salt = odd(shingle), odd(rows), odd(bands)

    def shingles(self, text: str) -> np.ndarray:
        """The sorted distinct shingle hashes; words are parts between white space, A-Z in lower case."""
        words = text.encode().lower().split()
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        hashes = np.fromiter(map(self.word, words), np.uint64, n)
        width = min(n, self.shingle)
        m = n - width + 1
        total = np.full(m, _U64(width), np.uint64)
        for i in range(width):
            total += hashes[i : i + m] * self.weights[i]
        return np.unique(_mix(total))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Coordinate k: the least value of the second permutation, shifted by k, over the scattered shingles."""
        places = self.scatter[(shingles >> _U64(44)).astype(np.int64)]
        least = self.shifted[places[:_PART]].min(axis=0)
        for i in range(_PART, len(places), _PART):
            np.minimum(least, self.shifted[places[i : i + _PART]].min(axis=0), out=least)
        return least

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band."""
        rows = self.signature(shingles).astype(np.uint64).reshape(self.bands, self.rows)
        return _mix((rows * self.row_weights).sum(axis=1, dtype=np.uint64) + self.band_salt).view(np.int64)

    def bitmap(self, shingles: np.ndarray) -> np.ndarray:
        """Each shingle turns over one bit."""
        places = (shingles & _U64(64 * WORDS - 1)).astype(np.int64)
        odd = np.bincount(places, minlength=64 * WORDS) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (id, n, set_hash, bands, bits); null hash, bands and bits where the set is empty."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [T.StructField("id", df.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("set_hash", T.BinaryType()), T.StructField("bands", longs), T.StructField("bits", longs)]
    )

    def make():
        tool = Sketcher(shingle)

        def work(ids, texts):
            sets = [tool.shingles(x or "") for x in texts]
            return {
                "id": ids,
                "n": [len(x) for x in sets],
                "set_hash": [tool.digest(x.tobytes()) if len(x) else None for x in sets],
                "bands": [tool.keys(x) if len(x) else None for x in sets],
                "bits": [tool.bitmap(x) if len(x) else None for x in sets],
            }

        return work

    return map_rows(df.select(id_col, text_col), make, schema)


def shingle_sets(df: DataFrame, shingle: int) -> DataFrame:
    """Rows (node, n, which, shingles) of rows (node, text); ``which``: the set's hash."""
    schema = T.StructType([T.StructField("node", df.schema["node"].dataType), T.StructField("n", T.LongType()), T.StructField("which", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def make():
        tool = Sketcher(shingle, 1, 1)

        def work(nodes, texts):
            sets = [tool.shingles(x or "").view(np.int64) for x in texts]
            which = [int.from_bytes(tool.digest(x.tobytes())[:8], "little", signed=True) for x in sets]
            return {"node": nodes, "n": [len(x) for x in sets], "which": which, "shingles": pa.array(sets, pa.list_(pa.int64()))}

        return work

    return map_rows(df.select("node", "text"), make, schema)


def _near(percent: int) -> Column:
    """Whether a pair (n, bits) and (n_a, bits_a) can be similar enough, by sizes and bitmaps."""
    apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bits_a")[i])) for i in range(1, WORDS)), F.bit_count(F.col("bits")[0].bitwiseXOR(F.col("bits_a")[0])))
    sizes = 100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a")
    return sizes & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("n_a")))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Of the distinct pairs (a, b) those with 100 * intersection >= percent * union over the full sets, as a table (u, v)."""
    pairs = scratch.save(pairs, "pairs")
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    n = pairs.count()
    both = salted_join(salted_join(pairs, left, "a", F.col("b"), n), right, "b", F.col("a"), n)
    met = F.size(F.array_intersect("sa", "sb")).cast("long")
    found = both.withColumn("met", met).where(100 * F.col("met") >= percent * (F.col("na") + F.col("nb") - F.col("met")))
    links = scratch.save(found.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "links")
    scratch.drop(pairs)
    return links


def _by_rarest(active: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of the nodes (node, n, bits, component), of different components, that prefix filter and bitmaps allow.

    Shingles are in one order, the rarest first. If two sets, x not the larger,
    have an overlap of at least t, the first |x| - t + 1 of x and the first
    |y| - t + 1 of y have a shingle in common; t is bounded by either size alone.
    At the first such shingle, i before it in x and j in y, the rest must suffice.
    """
    own = sets.join(active.select("node"), "node", "left_semi").select("node", "n", "which", F.explode("shingles").alias("shingle"))
    own = scratch.save(own, "shingles")
    shared = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    ranked = salted_join(own, shared, "shingle", F.col("node"), own.count()).groupBy("node", "n", "which").agg(F.array_sort(F.collect_list(F.struct("f", "shingle"))).alias("x"))
    # shingles of no other node come first, and are no keys
    lone = F.col("n") - F.size("x")
    least = lambda share: F.ceil(F.col("n") * F.lit(share) - 1e-6).cast("long")
    prefix = lambda share: F.slice("x", 1, F.greatest(F.lit(0), F.col("n") - least(share) + 1 - lone).cast("int"))
    low, high = 2 * percent / (100 + percent), percent / 100
    keyed = lambda share: ranked.select("node", "n", lone.alias("lone"), F.posexplode(prefix(share)).alias("at", "s")).select("node", "n", (F.col("lone") + F.col("at")).alias("at"), F.col("s.shingle").alias("key"))
    info = active.select("node", "bits", "component")
    probe = scratch.save(keyed(high).join(info, "node"), "probe")
    small = probe.where(F.col("at") <= F.col("n") - least(low))
    small = small.select("key", *(F.col(c).alias(f"{c}_a") for c in ("node", "n", "at", "bits", "component")))
    need = F.ceil((F.col("n") + F.col("n_a")) * F.lit(percent / (100 + percent)) - 1e-6)
    room = F.least(F.col("n") - F.col("at"), F.col("n_a") - F.col("at_a")) >= need
    once = (F.col("n_a") < F.col("n")) | ((F.col("n_a") == F.col("n")) & (F.col("node_a") < F.col("node")))
    met = salted_join(probe, small, "key", F.col("node"), probe.count())
    pairs = met.where(once & (F.col("component") != F.col("component_a")) & room & _near(percent))
    return pairs.select(F.col("node_a").alias("a"), F.col("node").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``df``: id, n_shingles, component_id (smallest id reachable), kept.

    ``percent``: documents are linked from this Jaccard similarity on.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = scratch.save(sketch(docs, "id", "text", shingle), "sketches")
    with_set = sketches.where("id is not null and set_hash is not null")
    classes = scratch.save(with_set.groupBy("set_hash").agg(F.min("id").alias("node")), "classes")
    nodes = with_set.select(F.col("id").alias("node"), "set_hash", "n", "bands", "bits").join(classes, ["node", "set_hash"], "left_semi")
    again = scratch.save(with_set.groupBy("id").agg(F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "again")
    repeated = not again.isEmpty()

    def once(rows: DataFrame, name: str) -> DataFrame:
        """``rows`` without repeated ones, which only ids that occur again have."""
        if not repeated:
            return rows
        ids = again.select(F.col("id").alias(name))
        return rows.join(ids, name, "left_anti").unionByName(rows.join(ids, name, "left_semi").distinct())

    nodes = once(nodes, "node")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = scratch.save(keyed.join(crowded, "key"), "met")
    # bitmaps follow once it is clear who meets at all
    buckets = scratch.save(met.join(nodes.select("node", "n", "bits"), "node"), "buckets")
    total = buckets.count()
    wanted = sized(scratch.save(met.select(F.col("node").alias("id")).distinct(), "wanted"))
    sets = scratch.save(shingle_sets(once(docs.join(wanted, "id", "left_semi"), "id").select(F.col("id").alias("node"), "text"), shingle), "sets")

    def apart(rows: DataFrame, centre: DataFrame) -> DataFrame:
        """The pairs (a, b) that the bounds allow of nodes and a centre of their bucket."""
        met = salted_join(rows, centre, "key", F.col("node"), total).where((F.col("component") != F.col("component_a")) & _near(percent))
        return met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()

    def centres(rows: DataFrame) -> DataFrame:
        return rows.select("key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"), F.col("component").alias("component_a"))

    by_id = with_set.join(again.where("lo <> hi").select("id"), "id", "left_semi").join(classes, "set_hash").where("node <> id").select(F.col("id").alias("u"), F.col("node").alias("v"))
    alone = buckets.withColumn("component", F.col("node"))
    first = alone.groupBy("key").agg(F.min(F.struct("node", "n", "bits", "component")).alias("c")).select("key", "c.*")
    links = _confirmed(apart(alone, centres(first)), sets, percent, scratch)
    labels = scratch.save(connected_components(links.unionByName(by_id), scratch), "labels")

    for last in (False, True):
        member = buckets.where("size > 2").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        active = scratch.save(salted_join(member, mixed, "key", F.col("node"), total), "active")
        if active.isEmpty():
            break
        if last:
            pairs = _by_rarest(active.dropDuplicates(["node", "bits"]), sets, percent, scratch)
        else:
            place = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
            few = active.where(place < F.ceil(F.lit(float(1 << 30) * CENTRES) / F.col("size")))
            pairs = apart(active, centres(few))
        links = _confirmed(pairs, sets, percent, scratch)
        if not links.isEmpty():
            labels = scratch.save(merge_components(labels, links, scratch), "labels")
        scratch.drop(active)

    scratch.clear(sketches, classes, labels)  # all that the result reads
    of_class = classes.join(labels, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component"))
    found = salted_join(sketches.select("id", "n", "set_hash"), of_class, "set_hash", F.monotonically_increasing_id(), sketches.count(), "left")
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` that are kept, one for each group; of rows that share an id one stays.

    Texts stay where they are as long as the ids of the rows to go are few, by a
    count of their bytes; rows of ids that occur once meet in no aggregation.
    """
    scratch = Scratch(df.sparkSession, "near")
    ids = near_duplicates(df, id_col, text_col, shingle, percent).where(F.col(id_col).isNotNull())
    found = scratch.save(ids.groupBy(id_col).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")), "ids")
    gone = scratch.save(found.where("not kept or rows > 1").select(id_col), "gone")
    rest = df.join(sized(gone), id_col, "left_anti").select(*df.columns)
    again = scratch.save(found.where("kept and rows > 1").select(id_col), "again")
    if again.isEmpty():
        return rest
    one = df.join(sized(again), id_col, "left_semi").groupBy(id_col).agg(F.min_by(F.struct(*df.columns), F.xxhash64(text_col)).alias("x")).select("x.*")
    return rest.unionByName(one)


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents on four-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)


#: All pairs that share a shingle, and what is reachable over those alike: for small tables, as groups are squared.
OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS g FROM words
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
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON node = doc_id
"""
