"""Joins on keys of which a few may hold most of the rows, and joins to few keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy that holds more than one of so many parts of the rows, so there are fewer heavy keys than parts; rows of a part at least.
PARTS, LEAST = 1024, 64
#: Rows that one task may well hold, so that no key of them is heavy.
SMALL = 4096
#: Bytes of keys up to which they are broadcast, counted before.
FEW_BYTES = 16 << 20


def sized(keys: DataFrame) -> DataFrame:
    """``keys``, a written table of one column, to be broadcast if its counted size is small, so that what it meets stays where it is."""
    (name,) = keys.columns
    each = F.octet_length(F.col(name).cast("string").cast("binary")) + 16
    return F.broadcast(keys) if (keys.agg(F.sum(each)).first()[0] or 0) <= FEW_BYTES else keys


def salted_join(many: DataFrame, one: DataFrame, key: str, by: Column, total: int, how: str = "inner", parts: int = PARTS) -> DataFrame:
    """``many`` (of ``total`` rows) joined to ``one`` on ``key``, inner or left, as ``many.join(one, key, how)``.

    A heavy key of ``many`` is dealt in pieces, by the hash of ``by``, each of
    which meets a copy of that key's rows of ``one``; copies are as many as the
    pieces, at most twice ``parts`` in all. Only heavy keys and their numbers of
    pieces, less than ``parts`` rows, are broadcast. Rows with a null key are
    spread too. No column may be named ``_pieces`` or ``_piece``.
    """
    if total <= SMALL:
        return many.join(one, key, how)
    parts = min(parts, total // LEAST + 1)
    sizes = many.groupBy(key).agg(F.count(F.lit(1)).alias("_pieces")).where(F.col("_pieces") > total / parts)
    heavy = F.broadcast(sizes.select(key, F.ceil(F.col("_pieces") * F.lit(parts / max(total, 1))).cast("int").alias("_pieces")))
    piece = F.pmod(F.xxhash64(by), F.when(F.col(key).isNull(), parts).otherwise(F.coalesce("_pieces", F.lit(1)))).cast("int")
    dealt = many.join(heavy, key, "left").withColumn("_piece", piece).drop("_pieces")
    copies = one.join(heavy, key, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return dealt.join(copies, [key, "_piece"], how).drop("_piece")


def lookup(many: DataFrame, one: DataFrame, key: str, by: Column, few_bytes: int = FEW_BYTES, parts: int = 32) -> DataFrame:
    """``many`` joined left to ``one``, which has a row for each ``key`` and mostly is small, as ``many.join(one, key, "left")``.

    ``one`` is broadcast if its counted bytes are few. Beyond that each of its rows is
    copied ``parts`` times, and the rows of ``many`` are dealt by the hash of ``by``: so no key
    is hot, without ``many`` being counted before. No column may be named ``_piece``.
    """
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string").cast("binary")), F.lit(0)) + 16 for c in one.columns), F.lit(0))
    if (one.agg(F.sum(size)).first()[0] or 0) <= few_bytes:
        return many.join(F.broadcast(one), key, "left")
    dealt = many.withColumn("_piece", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    copies = one.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(copies, [key, "_piece"], "left").drop("_piece")


def tasks(spark: SparkSession) -> int:
    """As many tasks as the session shuffles to, and at least two for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt to as many tasks as the session shuffles to, and at least two for each core, by the hash of ``by``.

    For rows that are few bytes and much work: a scan cuts files by their bytes, and the
    adaptive plan joins small partitions, so that one task would do the work of all.
    Streams stay as they are.
    """
    if df.isStreaming:
        return df
    return df.repartition(tasks(df.sparkSession), F.xxhash64(*by))
