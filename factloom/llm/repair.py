"""Repair of conversations, each distinct signature solved once.

A conversation's rows become a compact string, a letter for the role's initial
and the fault of each row. The cheapest edits of each distinct string are found
once, by recursion on its halves that remembers every half: a half is a table of
the best edits from each state of the wanted pattern to each other. The audits
are joined back to the conversations, and the edits are replayed on their rows.

Equal rows (same turn, role and text) are one row with a count until then. Rows
are put in order by a range partitioning over all of them, and a conversation's
part of each range is a section; positions are sums of section lengths. So a
conversation of any length is in no task as rows, and its texts come to one
task only as a stream of joined pieces, for the hash that has to read them in
order; its letters and its audit are one string, as they are in the result.

An insertion never pays: without it and the row it is paired with (and the only
system row, if no pair is left) the rest costs less. It is searched all the same.

Defined results: nulls are one space in what is read, and a null conversation is
a conversation, null in the result; a null turn comes first and is no turn; rows
of one turn come by their role's initial and a hash of role and text; equal rows are
copies of which the first is no duplicate; gaps beyond a long are null; a role whose initial is not s, u or a (an
empty one has none) can't be kept; empty texts are blank; conversations without
a row after the damage have counts of 0, no audit and the hash of no bytes; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from factloom.plans.arrow import giving_back, map_rows
from factloom.plans.scratch import Scratch
from factloom.plans.skew import salted_join

#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the pattern (s?(ua)+)?: nothing yet, behind s, behind u, behind a; those in which it may end.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_STATES, _ENDS = range(4), (0, 3)
#: Letters of rows as they are, of truncated rows, and of rows that must go; by the initials s, u, a and all others.
_AS_IS, _CUT, _GONE = "suao", "SUAO", "1234"
#: Rows of a section, and rows joined into one piece of text.
SECTION, PIECE = 20_000, 256
#: Remembered strings, and how long they are at most.
_KEPT, _SHORT = 1 << 16, 64

Best = dict[tuple[int, int], tuple[int, str, str]]  # (from, to) -> (cost, audit, edits with roles)


def _wanted(state: int) -> str:
    return "a" if state == 2 else "u"


def _joined(one: Best, two: Best) -> Best:
    """The best ways through both. Of equal cost none begins another, so the least audits of the parts make the least whole."""
    found: Best = {}
    for (q, m), (cost, audit, edits) in one.items():
        for r in _STATES:
            rest = two.get((m, r))
            if rest is not None:
                way = (cost + rest[0], audit + rest[1], edits + rest[2])
                if (q, r) not in found or way < found[q, r]:
                    found[q, r] = way
    return found


#: Nothing, or one insertion: two in a row come back to where they began.
_BETWEEN: Best = {(q, q): (0, "", "") for q in _STATES} | {(q, _NEXT[q, _wanted(q)]): (INSERT, "I", _wanted(q).upper()) for q in _STATES}


@functools.lru_cache(maxsize=64)
def _row(letter: str) -> Best:
    found: Best = {(q, q): (DELETE, "D", "d") for q in _STATES}
    if letter not in _GONE:
        left, role = (TRUNCATED if letter in _CUT else 0), letter.lower()
        for q in _STATES:
            ways = [(REROLE + left, "R", _wanted(q), _NEXT[q, _wanted(q)])]
            if (q, role) in _NEXT:
                ways.append((left, "K", "k", _NEXT[q, role]))
            for cost, audit, edit, r in ways:
                if (q, r) not in found or (cost, audit, edit) < found[q, r]:
                    found[q, r] = (cost, audit, edit)
    return _joined(_BETWEEN, found)


def _half(signature: str) -> Best:
    if len(signature) == 1:
        return _row(signature)
    middle = 1 << ((len(signature) - 1).bit_length() - 1)
    return _joined(_ways(signature[:middle]), _ways(signature[middle:]))


_remembered = functools.lru_cache(maxsize=_KEPT)(_half)


def _ways(signature: str) -> Best:
    return _remembered(signature) if len(signature) <= _SHORT else _half(signature)


def solve(signature: str) -> tuple[int, str, str]:
    """(cost, audit, edits): edits are k, d, u and a for a row that is kept, deleted or made user or assistant, U and A for an inserted one."""
    found = _joined(_ways(signature), _BETWEEN) if signature else _BETWEEN
    return min(found[0, q] for q in _ENDS if (0, q) in found)


def damaged(df: DataFrame) -> DataFrame:
    """Rows (conv, conv_id, turn, role, text, copies): as the damage leaves them; copies is 0 for a dropped row, 2 for a repeated one.

    ``conv`` names the conversation and is never null; nulls of role and text are one space.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    return df.withColumn("fault", fault).select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("conv"),
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(name("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _identity() -> Column:
    """A hash of a row's conversation, role and text."""
    return F.unhex(F.md5(F.concat("conv", F.lit("\n"), F.length("role").cast("string"), F.lit("\n"), "role", "text")))


def _last() -> Column:
    """The last character of the text that is no white space, empty where there is none."""
    return F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)


def _letters(kind: Column, role: Column) -> Column:
    """The letter of a fault (0 none, 1 truncated, 2 to be deleted) and an initial."""
    at = F.when(role == "s", 1).when(role == "u", 2).when(role == "a", 3).otherwise(4)
    return F.substring(F.when(kind == 0, _AS_IS).when(kind == 1, _CUT).otherwise(_GONE), at, F.lit(1))


def _solved(signatures: DataFrame) -> DataFrame:
    """Rows (signature, cost, audit, edits) of distinct signatures."""
    schema = T.StructType([T.StructField("signature", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("edits", T.ArrayType(T.StringType()))])

    def make():
        def work(given):
            found = [solve(x) for x in given]
            return {
                "signature": given,
                "cost": [x[0] for x in found],
                "audit": [x[1] for x in found],
                "edits": [re.findall("[UA]*[kuad]|[UA]+$", x[2]) for x in found],
            }

        return work

    return map_rows(signatures, make, schema)


def _hashed(pieces: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of pieces (conv, at, piece): their texts in order, joined by newlines, as one stream."""
    schema = T.StructType([T.StructField("conv", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for conv, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    if now is not None:
                        out.append({"conv": now, "repaired_sha256": state.hexdigest()})
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(piece.encode())
            yield pa.RecordBatch.from_pylist(out, schema=target)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"conv": now, "repaired_sha256": state.hexdigest()}], schema=target)

    return pieces.repartition("conv").sortWithinPartitions("conv", "at").select("conv", "piece").mapInArrow(giving_back(run), schema)


def repair(conversations: DataFrame, section: int = SECTION, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """Damaged conversations' audits, a row for each conversation (see ``op11_repair``), and the repaired rows (conv_id, conv, at, text of ``role:text`` lines).

    Texts are read twice: for the letters, and, of the rows that stay, for the repaired ones.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "repair")
    rows = damaged(conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")))
    last = _last()
    kind = F.when(last == "", 2).when(last.rlike("[.!?]"), 0).otherwise(1)
    light = rows.select("conv", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), _identity().alias("what"), (last == "").alias("blank"), kind.alias("kind"), "copies")
    # equal rows are one; rows that the damage dropped stay, with no copies, for their conversation
    light = light.groupBy("conv", "turn", "initial", "what", "blank", "kind").agg(F.sum("copies").alias("copies"), F.min("conv_id").alias("conv_id"))
    light = scratch.save(light, "rows")
    alive = light.where("copies > 0")

    # what was seen in an earlier turn
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    seen = alive.where("not blank").groupBy("what").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1").select("what", "first")
    n = alive.count()
    marked = salted_join(alive, seen, "what", F.col("turn"), n, "left")
    late = ~F.col("blank") & F.coalesce(turn > F.col("first"), F.lit(False))

    # in order over all rows; a conversation's rows of one range are a section of it
    order = ["conv", "turn", "initial", "what"]
    cut = marked.withColumn("late", late).drop("first").repartitionByRange(n // section + 1, *order).withColumn("part", F.spark_partition_id())
    letter = _letters(F.when(F.col("late"), 2).otherwise(F.col("kind")), F.col("initial"))
    others = F.when(F.col("copies") > 1, F.expr("repeat(substring('1234', case initial when 's' then 1 when 'u' then 2 when 'a' then 3 else 4 end, 1), cast(copies - 1 as int))")).otherwise("")
    cut = scratch.save(cut.withColumn("letters", F.concat(letter, others)), "sections")
    within = Window.partitionBy("conv", "part").orderBy(*order[1:])
    placed = cut.withColumn("at", F.coalesce(F.sum("copies").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sections = placed.groupBy("conv", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "letters"))), lambda x: x["letters"]), "").alias("letters"), F.sum("copies").alias("size"))
    sections = scratch.save(sections.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "parts")
    whole = sections.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "letters"))), lambda x: x["letters"]), "").alias("letters"))
    whole = scratch.save(whole.withColumn("signature", F.translate("letters", "234", "111")), "signatures")

    # each signature once
    solved = scratch.save(_solved(whole.select("signature").distinct()), "solved")
    found = scratch.save(salted_join(whole, solved, "signature", F.col("conv"), whole.count()), "audits")

    # edits back to the rows; the text of a row that stays comes by its hash, which no other that stays has
    edits = found.select("conv", F.posexplode("edits").alias("place", "edit")).where("edit <> 'd'").select("conv", F.col("place").cast("long").alias("place"), "edit")
    stays = cut.select("conv", "part", "turn", "initial", "what", "copies").withColumn("at", F.coalesce(F.sum("copies").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    stays = stays.join(sections.select("conv", "part", "before"), ["conv", "part"]).select("conv", (F.col("before") + F.col("at")).alias("place"), "what")
    kept = edits.join(stays, ["conv", "place"], "left").withColumn("what", F.when(F.col("edit").rlike("[kua]$"), F.col("what")))
    texts = rows.where("copies > 0").select(_identity().alias("what"), "role", "text").groupBy("what").agg(F.any_value("role").alias("role"), F.any_value("text").alias("text"))
    line = kept.where("what is null").select("conv", "place", "edit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    line = kept.where("what is not null").join(texts, "what").select("conv", "place", "edit", "role", "text").unionByName(line)
    role = F.when(F.col("edit").endswith("k"), F.col("role")).when(F.col("edit").endswith("u"), "user").when(F.col("edit").endswith("a"), "assistant")
    inserted = F.transform(F.regexp_extract_all("edit", F.lit("[UA]"), F.lit(0)), lambda c: F.when(c == "U", "user:").otherwise("assistant:"))
    lines = F.array_join(F.concat(inserted, F.when(role.isNotNull(), F.array(F.concat(role, F.lit(":"), "text"))).otherwise(F.array().cast("array<string>"))), "\n")
    repaired = line.select("conv", "place", lines.alias("lines"))

    # some lines are a piece; a conversation of one piece has its hash at once
    part = repaired.groupBy("conv", F.expr(f"place div {piece}").alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "lines"))), lambda x: x["lines"]), "\n").alias("piece"))
    ids = light.groupBy("conv").agg(F.min("conv_id").alias("conv_id"))
    pieces = scratch.save(part, "pieces")
    many = scratch.save(pieces.groupBy("conv").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("conv"), "many")
    digest = pieces.join(many, "conv", "left_anti").select("conv", F.sha2("piece", 256).alias("repaired_sha256")).unionByName(_hashed(pieces.join(many, "conv", "left_semi")))

    # counts
    single = F.when(F.col("blank"), 0).when(F.col("late"), F.col("copies")).otherwise(F.col("copies") - 1)
    faults = cut.groupBy("conv").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(single).alias("duplicate"),
        F.count_if((F.col("kind") == 1) & ~F.col("late")).alias("truncated"),
    )
    distinct = alive.where("turn is not null").groupBy("conv", F.col("turn").cast("decimal(20,0)").alias("turn")).agg(F.lit(1).alias("one"))
    turns = distinct.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).try_cast("long").alias("gaps"), F.lit(True).alias("numbered"))
    initials = F.translate("letters", _AS_IS + _CUT + _GONE, "suaosuaosuao")
    legal = F.regexp_count(initials, F.lit("(?=su|ua|au)"))
    audits = found.select("conv", (F.length("letters") - 1 - legal).cast("long").alias("illegal"), "cost", "audit")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    every = ids.join(turns, "conv", "left").join(faults, "conv", "left").join(audits, "conv", "left").join(digest, "conv", "left")
    result = every.select(
        "conv_id", F.when(F.col("numbered"), F.col("gaps")).otherwise(F.lit(0).cast("long")).alias("gaps"), *(zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
    return result, pieces.join(ids, "conv").select("conv_id", "conv", "at", F.col("piece").alias("text"))


def op11_repair(spark, sf_dir: str) -> DataFrame:
    """Audits of all conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))[0]


#: Letters by windows; the edits by going through all conversations at once, a row at a time, with the best way to each state; insertions, which never pay, left out.
OP11_SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT FOR x IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')],
      lambda c, b: list_reduce([xor(c, b)] || [k::BIGINT FOR k IN range(8)], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS fault FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM named
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role[1:1], md5(coalesce('c' || conv_id, 'n') || chr(10) || length(role) || chr(10) || role || text), copy) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM hurt
), faulty AS (
  SELECT *, CASE WHEN tail = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN tail NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f, role[1:1] AS r FROM ranked
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, '0000000000' AS v0, NULL::VARCHAR AS v1, NULL::VARCHAR AS v2, NULL::VARCHAR AS v3 FROM (SELECT DISTINCT conv_id FROM hurt)
  UNION ALL
  SELECT w.conv_id, x.i,
    lpad((v0[1:10]::INT + 2)::VARCHAR, 10, '0') || v0[11:] || 'D',
    least(lpad((v1[1:10]::INT + 2)::VARCHAR, 10, '0') || v1[11:] || 'D', CASE WHEN f NOT IN ('b', 'd') AND r = 's' THEN lpad((v0[1:10]::INT + y)::VARCHAR, 10, '0') || v0[11:] || 'K' END),
    least(lpad((v2[1:10]::INT + 2)::VARCHAR, 10, '0') || v2[11:] || 'D', CASE WHEN f NOT IN ('b', 'd') THEN least(
      lpad((v0[1:10]::INT + y + u)::VARCHAR, 10, '0') || v0[11:] || ku, lpad((v1[1:10]::INT + y + u)::VARCHAR, 10, '0') || v1[11:] || ku, lpad((v3[1:10]::INT + y + u)::VARCHAR, 10, '0') || v3[11:] || ku) END),
    least(lpad((v3[1:10]::INT + 2)::VARCHAR, 10, '0') || v3[11:] || 'D', CASE WHEN f NOT IN ('b', 'd') THEN lpad((v2[1:10]::INT + y + a)::VARCHAR, 10, '0') || v2[11:] || ka END)
  FROM walk w JOIN (SELECT conv_id, i, f, r, CASE f WHEN 't' THEN 5 ELSE 0 END AS y, CASE r WHEN 'u' THEN 0 ELSE 1 END AS u, CASE r WHEN 'u' THEN 'K' ELSE 'R' END AS ku, CASE r WHEN 'a' THEN 0 ELSE 1 END AS a, CASE r WHEN 'a' THEN 'K' ELSE 'R' END AS ka FROM faulty) x
    ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1
), best AS (
  SELECT conv_id, least(v0, v3) AS v FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS k FROM walk) WHERE k = 1
), edited AS (
  SELECT x.conv_id, i, role, text, r, v[10 + i : 10 + i] AS edit FROM faulty x JOIN best b ON x.conv_id IS NOT DISTINCT FROM b.conv_id
), stay AS (
  SELECT *, row_number() OVER w - 1 AS k, first_value(r = 's' AND edit = 'K') OVER w AS lead FROM edited WHERE edit <> 'D' WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - lead::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS lines FROM stay GROUP BY conv_id
), pairs AS (
  SELECT *, coalesce(lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au'), false) AS bad FROM faulty
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (bad) AS illegal FROM pairs GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(v[1:10]::BIGINT, 0) AS cost, coalesce(v[11:], '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN repaired p ON o.conv_id IS NOT DISTINCT FROM p.conv_id
"""
