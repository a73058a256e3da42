"""The vocabulary of sections and headers of a page collection, as a template to fill in."""

from __future__ import annotations

import functools
from collections import defaultdict
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import plain_accents
from factloom.operators.kb import property_by_label
from factloom.operators.rules import SECTION_PREFIX, SECTION_PROPERTY, SEPARATOR
from factloom.plans.components import connected_components
from factloom.plans.scratch import Scratch
from factloom.plans.skew import lookup, salted_join, sized

#: Example pages of a section, and letters by which names are found that may contain each other.
EXAMPLES, GRAM = 3, 3
#: Letters by which names of at least that length are looked up: the more names, the more of them share a part of three.
LEVELS = (GRAM, 6, 12)
#: Sections whose components are folded in one call, and the largest component that is.
FOLDED, LARGEST = 1000, 5000
#: Of larger components, the names whose work is measured together, and the relations that are folded in one call.
STEP, WORK = 1000, 1_000_000


def grams(low: str) -> set[str]:
    """All parts of up to ``GRAM`` letters."""
    return {low[i : i + k] for k in range(1, GRAM + 1) for i in range(len(low) - k + 1)}


def group_similar(sections: list[str]) -> dict[str, str]:
    """Each section's group, in order of appearance, case apart.

    A section joins the first group that has a member which contains it, or
    whose only member it contains; a group that is joined comes last from then on.
    """
    members: list[list[str]] = []
    place: list[int] = []
    holders: dict[str, set[int]] = defaultdict(set)  # groups by the parts of their members
    single: dict[str, set[int]] = defaultdict(set)  # groups of one member by its name
    for at, section in enumerate(dict.fromkeys(sections)):
        low = section.lower()
        own = [holders[low[i : i + GRAM]] if low[i : i + GRAM] in holders else set() for i in range(max(1, len(low) - GRAM + 1))]
        near = {g for g in (min(own, key=len) if low else range(len(members))) if any(low in m.lower() for m in members[g])}
        for i in range(len(low) + 1):
            for j in range(i, len(low) + 1):
                near |= single.get(low[i:j], set())
        if near:
            group = min(near, key=place.__getitem__)
            if len(members[group]) == 1:
                single[members[group][0].lower()].discard(group)
        else:
            group = len(members)
            members.append([])
            place.append(at)
            single[low].add(group)
        members[group].append(section)
        place[group] = at
        for x in grams(low):
            holders[x].add(group)
    return {s: SEPARATOR.join(own) for own in members for s in own}


def may_join(names: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of names (section) of which one contains the other, case apart.

    A name is looked up by the rarest of its parts of as many letters as the largest of
    ``LEVELS`` that it has, or by itself if it is shorter than all.
    """
    low = F.lower("section")
    parts = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("low") - k + 1, F.lit(1))), lambda i: F.substring(F.col("low"), i, F.lit(k)))
    every = names.select("section", low.alias("low"))
    level = lambda use: functools.reduce(lambda when, k: when.when(F.length("low") >= k, use(k)), LEVELS[:0:-1], F.when(F.length("low") < LEVELS[0], use(LEVELS[0]))).otherwise(use(LEVELS[0]))
    own = level(F.lit)
    asks = every.agg(*(F.coalesce(F.bool_or((own == k) & (F.length("low") >= k)), F.lit(False)).alias(f"k{k}") for k in LEVELS)).first()
    levels = [k for k in LEVELS if asks[f"k{k}"]]
    # parts shorter than GRAM are looked up by names that are no longer themselves
    short = every.where((F.length("low") < GRAM) & (F.col("low") != "")).select(F.col("low").alias("gram")).distinct()
    each = lambda *found: every.select("section", "low", F.explode(F.array_distinct(F.flatten(F.array(*found)))).alias("gram")).where("gram <> ''")
    held = each(*(parts(k) for k in levels or LEVELS[:1])).where(F.length("gram").isin(levels))
    if not short.isEmpty():
        held = held.unionByName(each(*(parts(k) for k in range(1, GRAM))).join(sized(scratch.save(short, "short")), "gram", "left_semi").select("section", "low", "gram"))
    held = scratch.save(held, "grams")
    n = held.count()
    whole = held.where((F.length("gram") == own) | (F.col("gram") == F.col("low")))
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("f"))
    # the rarest as a number, and then the part that has it: numbers are compared without sorting the names
    mark = lambda gram: F.pmod(F.xxhash64(gram), F.lit(1 << 20))
    least = salted_join(whole, counts, "gram", F.col("section"), n).groupBy("section", "low").agg(F.min(F.col("f") * (1 << 20) + mark(F.col("gram"))).alias("least"))
    rarest = least.select("section", "low", F.get(F.filter(level(parts), lambda x: mark(x) == F.pmod("least", F.lit(1 << 20))), F.lit(0)).alias("gram"))
    asked = rarest.select("gram", F.col("section").alias("u"), F.col("low").alias("short"))
    met = salted_join(held, asked, "gram", F.col("section"), n).where(F.col("low").contains(F.col("short")) & (F.col("section") != F.col("u")))
    found = met.select("u", F.col("section").alias("v"))
    if every.where("low = ''").isEmpty():
        return found
    return found.unionByName(every.where("low <> ''").select(F.lit("").alias("u"), F.col("section").alias("v")))


def in_order(names: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (section, at): the places of names in the order of (page_id, table_ord, section), from 0, by ranges whose sizes come first."""
    order = ["page_id", "table_ord", "section"]
    cut = scratch.save(names.select(*order).repartitionByRange(names.count() // 100_000 + 1, *order).withColumn("part", F.spark_partition_id()), "ordered")
    sizes = cut.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return cut.withColumn("within", within).join(F.broadcast(before), "part").select("section", (F.col("before") + F.col("within")).cast("long").alias("at"))


def _fold_block(rows: pd.DataFrame) -> pd.DataFrame:
    """(at, group) of a block of names, from rows (at, kind, other, place).

    kind 0 is a name; 1 and 2 are groups from before that have a member which contains
    it, or whose only member it contains; 3 and 4 are names of the block that contain
    it or that it contains. A group is named by the place of its first member.
    """
    rows = rows.sort_values(["at", "kind"], kind="stable")
    last: dict[int, int] = {}  # groups that the block joined, and when
    alone: set[int] = set()
    own: dict[int, int] = {}
    for at, of_name in groupby(rows[["at", "kind", "other", "place"]].itertuples(index=False, name=None), key=itemgetter(0)):
        best = None
        for _, kind, other, place in of_name:
            if kind == 1 or kind == 2 and other not in last:
                near = (last.get(other, place), other)
            elif kind == 3 or kind == 4 and own[other] in alone:
                near = (last[own[other]], own[other])
            else:
                continue
            best = near if best is None else min(best, near)
        group = at if best is None else best[1]
        alone.add(at) if best is None else alone.discard(group)
        last[group], own[at] = at, group
    return pd.DataFrame({"at": list(own), "group": list(own.values())}, columns=["at", "group"], dtype="int64")


def fold_in_blocks(names: DataFrame, pairs: DataFrame, scratch: Scratch, step: int = STEP, work: int = WORK) -> DataFrame:
    """``names`` (section, page_id, table_ord) with ``group``, as ``group_similar`` of all in order; nothing gathers them.

    ``pairs`` (u, v): names of which v contains u. Names are folded in blocks, one
    after another. What a block needs of the names before it is, for each of its own,
    the groups that it may join, the longest unjoined first, and of these one more than the
    block has names: so many can't all be joined before its turn.
    """
    order = scratch.save(in_order(names, scratch), "order")
    n_pairs = pairs.count()
    placed = salted_join(pairs, order.select(F.col("section").alias("u"), F.col("at").alias("at_u")), "u", F.col("v"), n_pairs)
    placed = salted_join(placed, order.select(F.col("section").alias("v"), F.col("at").alias("at_v")), "v", F.col("u"), n_pairs)
    later = lambda at, other, holds: placed.where(F.col(at) > F.col(other)).select(F.col(at).alias("at"), F.col(other).alias("other"), F.lit(holds).alias("holds"))
    related = scratch.save(later("at_u", "at_v", True).unionByName(later("at_v", "at_u", False)), "related")
    load = {r.k: r.n for r in related.groupBy(F.expr(f"at div {step}").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = order.count()
    members: DataFrame | None = None
    low = 0
    while low < total:
        high, cost = low + step, load.get(low // step, 0)
        while high < total and cost + load.get(high // step, 0) <= work:
            cost += load.get(high // step, 0)
            high += step
        block = related.where(F.col("at").between(low, high - 1))
        rows = order.where(F.col("at").between(low, high - 1)).select("at", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("other"), F.lit(-1).cast("long").alias("place"))
        inner = block.where(F.col("other") >= low).select("at", F.when(F.col("holds"), 3).otherwise(4).alias("kind"), "other", F.lit(-1).cast("long").alias("place"))
        rows = rows.unionByName(inner)
        if members is not None:
            groups = members.groupBy("group").agg(F.max("at").alias("place"), F.count(F.lit(1)).alias("size"))
            state = members.join(groups, "group").select(F.col("at").alias("other"), "group", "place", "size")
            before = block.where(F.col("other") < low)
            met = salted_join(before, state, "other", F.col("at"), before.count()).where(F.col("holds") | (F.col("size") == 1))
            met = met.groupBy("at", "group").agg(F.max("holds").alias("holds"), F.first("place").alias("place"))
            for by in ("at", F.pmod(F.xxhash64("group"), F.lit(64))), ("at",):
                met = met.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("place"))).where(F.col("k") <= high - low + 1)
            rows = rows.unionByName(met.select("at", F.when(F.col("holds"), 1).otherwise(2).alias("kind"), F.col("group").alias("other"), "place"))
        found = rows.groupBy(F.lit(0).alias("all")).applyInPandas(_fold_block, "at long, group long")
        after = scratch.save(found if members is None else members.unionByName(found), "members")
        if members is not None:
            scratch.drop(members)
        members, low = after, high
    return order.join(members, "at").select("section", "at", "group")


def section_vocabulary(refined: DataFrame, similar: bool = False, largest: int = LARGEST, work: int = WORK) -> DataFrame:
    """(section, group, first, examples) of tables with more than one row and headers.

    ``first``: the first (page_id, table_ord); ``examples``: up to three pages.
    Without ``similar`` a group is a section, and all is one aggregation. With it
    sections that contain each other, directly or over others, are found first,
    and only these are folded together, in order of appearance: no others can
    come into one group. An empty name is contained in all. Components of more
    than ``largest`` sections are folded in blocks of bounded work.
    """
    used = refined.where("n_rows > 1 and status <> 'E2'")
    pages = used.groupBy("section", "resource").agg(F.min(F.struct("page_id", "table_ord")).alias("first"))
    place = F.row_number().over(Window.partitionBy("section").orderBy("first", "resource"))
    few = pages.withColumn("n", place).where(F.col("n") <= EXAMPLES)
    found = few.groupBy("section").agg(F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("first", "resource"))).alias("x"))
    found = found.select("section", "first", F.array_join("x.resource", ", ").alias("examples"))
    if not similar:
        return found.withColumn("group", F.col("section"))
    scratch = Scratch(refined.sparkSession, "sections")
    found = scratch.save(found, "sections")
    pairs = scratch.save(may_join(found.select("section"), scratch), "pairs")
    own = scratch.save(connected_components(pairs, scratch).select(F.col("node").alias("section"), "component"), "components")
    large = own.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > largest).select("component")
    of_large = scratch.save(salted_join(own, large, "component", F.col("section"), own.count()).select("section"), "large")
    order = found.select("section", F.col("first.page_id").alias("page_id"), F.col("first.table_ord").alias("table_ord"))
    small = order.join(own, "section").join(of_large, "section", "left_anti")

    def fold(names: pd.DataFrame) -> pd.DataFrame:
        listed = sorted(names[["component", "page_id", "table_ord", "section"]].itertuples(index=False, name=None))
        out = [x for _, rows in groupby(listed, key=itemgetter(0)) for x in group_similar([r[3] for r in rows]).items()]
        return pd.DataFrame(out, columns=["section", "group"])

    # components are folded some at a time
    part = F.pmod(F.xxhash64("component"), F.lit(found.count() // FOLDED + 1)).alias("part")
    groups = small.groupBy(part).applyInPandas(fold, "section string, group string")
    if not of_large.isEmpty():
        ends = salted_join(pairs, of_large.select(F.col("section").alias("u")), "u", F.col("v"), pairs.count())
        held = scratch.save(fold_in_blocks(order.join(of_large, "section", "left_semi"), ends, scratch, min(STEP, work), work), "folded")
        named = held.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "section"))), lambda x: x["section"]), SEPARATOR).alias("name"))
        groups = groups.unionByName(salted_join(held, named, "group", F.col("at"), held.count()).select("section", F.col("name").alias("group")))
    return found.join(groups, "section", "left").withColumn("group", F.coalesce("group", "section"))


def header_vocabulary(refined: DataFrame, sections: DataFrame, rules: DataFrame, kb: DataFrame | None = None, lang: str = "en") -> DataFrame:
    """(group, header, property): distinct headers of each group; the property by strict rule, by header, by label, or empty.

    ``rules``: (kind, key, property) of one chapter.
    """
    used = refined.where("n_rows > 1 and status <> 'E2'").select("section", F.explode("headers_refined").alias("header"))
    pairs = used.join(sections.select("section", "group"), "section").select("group", F.replace("header", F.lit("'"), F.lit("")).alias("header")).distinct()
    strict = rules.where("kind in ('strict', 'any')").select(F.col("key").alias("strict_key"), F.col("property").alias("a"))
    loose = rules.where("kind in ('loose', 'any')").select(F.col("key").alias("header"), F.col("property").alias("b"))
    found = lookup(pairs.withColumn("strict_key", F.concat_ws("_", "group", "header")), strict, "strict_key", F.col("group"))
    found = lookup(found, loose, "header", F.col("group"))
    if kb is not None:
        found = found.join(property_by_label(found.where("a is null and b is null").select("header"), kb, lang).withColumnRenamed("property", "c"), "header", "left")
    else:
        found = found.withColumn("c", F.lit(None).cast("string"))
    return found.select("group", "header", F.coalesce("a", "b", "c", F.lit("")).alias("property"))


def template(sections: DataFrame, headers: DataFrame, rules: DataFrame, output_format: int = 1) -> DataFrame:
    """(section, header, property, examples): a row for each group's own property and for its headers.

    Format 2 lists a header only at the first group in order that has it.
    """
    own = rules.where("kind = 'section'").select(F.col("key").alias("k"), F.col("property").alias("property"))
    groups = sections.groupBy("group").agg(F.min_by("examples", "first").alias("examples"))
    heads = groups.withColumn("k", F.concat(F.lit(SECTION_PREFIX), "group")).join(own, "k", "left")
    name = F.translate(plain_accents(F.col("group")), " -", "__")
    top = heads.select("group", name.alias("section"), F.lit(SECTION_PROPERTY).alias("header"), F.coalesce("property", F.lit("")).alias("property"), "examples")
    listed = headers
    if output_format == 2:
        first = F.row_number().over(Window.partitionBy("header").orderBy("group"))
        listed = headers.withColumn("n", first).where("n = 1")
    rest = listed.select("group", name.alias("section"), "header", "property", F.lit(None).cast("string").alias("examples"))
    return top.unionByName(rest).select("section", "header", "property", "examples")


def check_arguments(chapter: str, output_format: int, single: str | None = None, topic: str | None = None, where: str | None = None, languages: tuple[str, ...] = ("en", "it", "fr", "de", "pt", "es"), one: bool = True) -> None:
    """Raise ValueError for arguments that name no chapter, class or format, or, if ``one``, not exactly one choice of pages."""
    if chapter not in languages:
        raise ValueError(f"chapter is one of {', '.join(languages)}")
    if output_format not in (1, 2):
        raise ValueError("output format is 1 or 2")
    if one and sum(x is not None for x in (single, topic, where)) != 1:
        raise ValueError("one of a single resource, a class and a pattern")
    if topic is not None and not topic.isalpha():
        raise ValueError("a class is letters only")
