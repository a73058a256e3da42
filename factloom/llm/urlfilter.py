"""URL filters: dated list entries as validity intervals, and captures as of their fetch time.

A list entry (key, action, day) holds from its day until the next entry of its
key. ``block`` and ``allow`` decide, ``remove`` ends what was said before. A key
is a host or any of its parent domains. A capture is judged by the entries that
hold on its fetch day, of these by the longest key.

Captures are reduced to distinct pairs of host and day before anything meets
the list; one host with many captures is then a row for each day. The list is
joined by key and interval, and a pair meets at most one interval of a key, so
the join makes no more rows than hosts have labels. A top-level domain is a
parent of half of all hosts, and one host may have half of a day's captures:
both joins deal such keys in pieces.

Defined results: a null or unparsable url and a null day match nothing and are
not blocked; of entries with one key and day the last action by name counts; an
entry with a null key, action or day counts for nothing; an empty list blocks
nothing; repeated captures are judged each; a null id stays null; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.plans.scratch import Scratch
from factloom.plans.skew import salted_join

_HOST = r"^[a-z][a-z0-9+.-]*://([^/?#@]*@)?([^/?#:@]+)"
#: Entries of the registered query besides those that it makes of the hosts.
FIXED_ENTRIES = (
    ("example.com", "block", "2024-02-01"),
    ("example.com", "remove", "2024-04-01"),
    ("example.net", "allow", "2024-01-01"),
    ("example.net", "block", "2024-07-01"),
    ("example.org", "block", "2024-09-15"),
    ("m.example.org", "allow", "2024-10-01"),
)


def host_of(url: F.Column) -> F.Column:
    """The host of ``url`` in lower case, without user, port and final point; null where there is none."""
    host = F.rtrim(F.regexp_extract(F.lower(url), _HOST, 2), F.lit("."))
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until) of entries (key, action, day); until: exclusive, null if open."""
    one = entries.where("key is not null and action is not null and day is not null").groupBy(F.lower("key").alias("key"), "day").agg(F.max("action").alias("action"))
    until = F.lead("day").over(Window.partitionBy("key").orderBy("day"))
    return one.select("key", "action", F.col("day").alias("since"), until.alias("until")).where("action <> 'remove'")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetch_day") -> DataFrame:
    """One row for each capture: id, host, fetch_day, entry (its key), action, blocked."""
    scratch = Scratch(captures.sparkSession, "urls")
    parsed = captures.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), F.col(day_col).alias("day"))
    rows = scratch.save(parsed.withColumn("pair", F.concat("host", F.lit(" "), F.col("day").cast("string"))), "captures")
    pairs = rows.where("pair is not null").select("pair", "host", "day").distinct()
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.concat_ws(".", F.slice(F.col("labels"), i, F.size("labels")))))
    keyed = scratch.save(pairs.withColumn("labels", labels).select("pair", "day", suffix.alias("key")), "keys")
    held = intervals(entries)
    met = salted_join(keyed, held, "key", F.col("pair"), keyed.count()).where("day >= since and (until is null or day < until)")
    best = met.groupBy("pair").agg(F.max(F.struct(F.length("key").alias("n"), F.col("key").alias("entry"), "action")).alias("best"))
    return salted_join(rows, best, "pair", F.col("id"), rows.count(), "left").select(
        F.col("id").alias(id_col),
        "host",
        F.col("day").alias("fetch_day"),
        F.col("best.entry").alias("entry"),
        F.col("best.action").alias("action"),
        F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"),
    )


def op6_urlfilter(spark, sf_dir: str) -> DataFrame:
    """Every page against a dated list.

    The pages carry no dates: the fetch day follows from the url's hash, and one
    host in ten is listed from a day of its own on, for 60 days.
    """
    number = lambda text, at: F.conv(F.substring(F.md5(text.cast("binary")), at, 6), 16, 10).cast("int")
    start = F.lit("2024-01-01").cast("date")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.date_add(start, F.pmod(number(F.col("url"), 1), F.lit(366))).alias("fetch_day"))
    hosts = pages.select(host_of(F.col("url")).alias("key")).where("key is not null").distinct().where(F.pmod(number(F.col("key"), 7), F.lit(10)) == 0)
    since = F.date_add(start, F.pmod(number(F.col("key"), 1), F.lit(366)))
    listed = hosts.select("key", F.explode(F.array(F.struct(F.lit("block").alias("action"), since.alias("day")), F.struct(F.lit("remove").alias("action"), F.date_add(since, 60).alias("day")))).alias("e"))
    fixed = spark.createDataFrame(FIXED_ENTRIES, "key string, action string, day string").withColumn("day", F.col("day").cast("date"))
    judged = judge(pages, fixed.unionByName(listed.select("key", "e.action", "e.day")))
    return judged.withColumn("fetch_day", F.col("fetch_day").cast("string"))


OP6_SQL = rf"""
WITH pages0 AS (
  SELECT page_id, nullif(rtrim(regexp_extract(lower(url), '{_HOST}', 2), '.'), '') AS host,
         CAST(DATE '2024-01-01' + CAST(('0x' || substr(md5(url), 1, 6))::BIGINT % 366 AS INTEGER) AS DATE) AS fetch_day
  FROM pages
), hosts AS (
  SELECT host AS key, CAST(DATE '2024-01-01' + CAST(('0x' || substr(md5(host), 1, 6))::BIGINT % 366 AS INTEGER) AS DATE) AS since
  FROM (SELECT DISTINCT host FROM pages0 WHERE host IS NOT NULL) WHERE ('0x' || substr(md5(host), 7, 6))::BIGINT % 10 = 0
), entries AS (
  SELECT * FROM (VALUES {", ".join(f"('{k}', '{a}', DATE '{d}')" for k, a, d in FIXED_ENTRIES)}) t(key, action, day)
  UNION ALL SELECT key, 'block', since FROM hosts
  UNION ALL SELECT key, 'remove', CAST(since + 60 AS DATE) FROM hosts
), single AS (
  SELECT key, day, max(action) AS action FROM entries GROUP BY key, day
), held AS (
  SELECT * FROM (SELECT key, action, day AS since, lead(day) OVER (PARTITION BY key ORDER BY day) AS until FROM single) WHERE action <> 'remove'
), ranked AS (
  SELECT p.page_id, h.key, h.action, row_number() OVER (PARTITION BY p.page_id ORDER BY length(h.key) DESC) AS r
  FROM pages0 p JOIN held h ON (p.host = h.key OR ends_with(p.host, '.' || h.key)) AND p.fetch_day >= h.since AND (h.until IS NULL OR p.fetch_day < h.until)
)
SELECT p.page_id, p.host, strftime(p.fetch_day, '%Y-%m-%d') AS fetch_day, r.key AS entry, r.action, coalesce(r.action = 'block', false) AS blocked
FROM pages0 p LEFT JOIN ranked r ON p.page_id = r.page_id AND r.r = 1
"""
