"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

The unit of placement is a group of equal texts. Groups fall by the hash of
their text into a bounded number of bundles; a group that is heavy in any
dimension is a bundle of its own, and one heavier than a shard is split by row,
by a number that each row has of its own, whatever its id.
The bundles, largest first, go to the shard where the dot product of their
demand with its residual capacity is highest (shares of the capacity), among
those with room. Only the bundles' sums, whose number is bounded by parameters,
reach the driver; the rows get their shard by a join on the bundle.

Tokens are given by a column, or else estimated as words: parts between blanks.

Defined results: a null text has no bytes and no tokens and forms a group with
other null texts, apart from empty ones; repeated rows are one group; a null id
is placed as any other; which rows of a split group go where, and the order of
slots, follow the order in which the table is read; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.plans.scratch import Scratch

#: Bundles for each shard; a group over this fraction of a shard's capacity is heavy; bytes added to each row; rows in one numbering group.
BUNDLES, HEAVY, ROW_BYTES, NUMBERED = 200, 1 / 64, 16, 100_000


def place(demand: np.ndarray, shards: int, slack: tuple[float, ...] = (0.2, 0.0, 0.2)) -> np.ndarray:
    """A shard for each row of ``demand`` (bundles x dimensions), so that all dimensions balance.

    ``slack``: room over an equal share, for each dimension. What fits nowhere
    goes where most room is left in the dimension of the least slack.
    """
    capacity = np.maximum(demand.sum(axis=0) / shards, 1e-9)
    need = demand / capacity
    order = np.lexsort((np.arange(len(need)), -need.max(axis=1)))
    room = np.ones((shards, need.shape[1])) + np.array(slack)
    tight = int(np.argmin(slack))
    out = np.zeros(len(need), np.int64)
    for i in order:
        fits = (room >= need[i] - 1e-12).all(axis=1)
        out[i] = np.argmax(np.where(fits, room @ need[i], -np.inf)) if fits.any() else np.argmax(room[:, tight])
        room[out[i]] -= need[i]
    return out


def shard(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", bundles: int = BUNDLES, tokens_col: str | None = None) -> DataFrame:
    """One row for each row of ``df``: id, size, text_crc32, shard, slot (gapless from 0 within a shard).

    ``tokens_col``: the number of tokens of each row, null for none; else words stand for them.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.col(text_col).cast("string")
    raw = text.cast("binary")
    spaces = F.length(text) - F.length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    words = F.when(F.length(text) > 0, spaces.cast("long") + 1)
    rows = scratch.save(
        df.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
            F.coalesce(words if tokens_col is None else F.col(tokens_col).cast("long"), F.lit(0).cast("long")).alias("tokens"),
            F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
            F.xxhash64(text, F.lit(17)).alias("h1"),
            F.xxhash64(F.lit(29), text).alias("h2"),
            F.xxhash64(F.monotonically_increasing_id()).alias("own"),
        ),
        "rows",
    )
    total = rows.agg(F.count(F.lit(1)), F.sum("size"), F.sum("tokens")).first()
    if not total[0]:
        return rows.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    share = [max(x / shards, 1.0) for x in total]
    load = [F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.sum("tokens").alias("t")]
    fullest = F.greatest(F.col("n") / F.lit(share[0]), F.col("b") / F.lit(share[1]), F.col("t") / F.lit(share[2]))
    # heavy groups: at most 3 * shards / HEAVY, as each takes HEAVY of a shard in some dimension
    heavy = rows.groupBy("h1", "h2").agg(*load).where(fullest > HEAVY).select("h1", "h2", F.when(fullest > 1, F.ceil(fullest * 8)).otherwise(1).cast("int").alias("split"))
    tagged = rows.join(F.broadcast(scratch.save(heavy, "heavy")), ["h1", "h2"], "left")
    piece = F.when(F.col("split") > 1, F.pmod("own", "split")).otherwise(0)
    bundle = F.when(F.col("split").isNull(), F.struct(F.pmod("h1", F.lit(shards * bundles)).alias("x"), F.lit(0).cast("long").alias("y"), F.lit(-1).cast("long").alias("z"))).otherwise(
        F.struct(F.col("h1").alias("x"), F.col("h2").alias("y"), piece.cast("long").alias("z"))
    )
    tagged = tagged.select("id", "size", "tokens", "text_crc32", "own", bundle.alias("bundle"))
    sums = tagged.groupBy("bundle").agg(*load).orderBy("bundle").collect()
    shard_of = place(np.array([[r["n"], r["b"], r["t"]] for r in sums], np.float64), shards)
    table = spark.createDataFrame([(tuple(r["bundle"]), int(s)) for r, s in zip(sums, shard_of, strict=True)], "bundle struct<x:bigint,y:bigint,z:bigint>, shard int")
    parts = max(8, -(-total[0] // (shards * NUMBERED)))
    placed = tagged.join(F.broadcast(table), "bundle").withColumn("part", F.pmod(F.xxhash64("own"), F.lit(parts)))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("own"))
    numbered = placed.select("id", "size", "text_crc32", "shard", "part", number.alias("number"))
    return numbered.join(before, ["shard", "part"]).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("before") + F.col("number") - 1).alias("slot"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of near equal bytes."""
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
