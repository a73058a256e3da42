"""Sections folded in blocks, against the fold over all of them."""

from __future__ import annotations

import random

import pytest

from factloom.operators import explore

SHAPE = "page_id long, resource string, table_ord int, section string, n_rows int, status string"


def refined(spark, names):
    return spark.createDataFrame([(i, f"P{i}", 0, s, 3, "OK") for i, s in enumerate(names)], SHAPE)


def random_names(rng, n, letters, most):
    return list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randrange(1, most))) for _ in range(n)))


@pytest.mark.parametrize("work", [1, 40, 10**6])
def test_blocks_fold_as_one(spark, work, monkeypatch):
    """Blocks of few names, components of any size: an empty name first, last or between, single letters, names that differ in case."""
    monkeypatch.setattr(explore, "STEP", 7)
    rng = random.Random(work)
    names = random_names(rng, 60, "abcdeA ", 8)
    for own in (names, ["", *names[:40]], [*names[:25], "", *names[25:50]]):
        found = explore.section_vocabulary(refined(spark, own), True, largest=2, work=work).collect()
        assert {r["section"]: r["group"] for r in found} == explore.group_similar(own)


def test_one_component_of_many(spark):
    """Names that an empty one joins into one component are folded in bounded blocks."""
    rng = random.Random(8)
    names = random_names(rng, 2600, "abcdefghijklmnopqrstuvwxyz", 12)
    names = [*names[:900], "", *names[900:]]
    found = explore.section_vocabulary(refined(spark, names), True, largest=100, work=20_000).select("section", "group").collect()
    assert {r["section"]: r["group"] for r in found} == explore.group_similar(names)


def test_names_are_looked_up_by_parts_as_long_as_they_have(spark):
    """Many names of one pattern share their parts of three letters; longer parts tell them apart, and no pair is lost."""
    from factloom.plans.scratch import Scratch

    rng = random.Random(3)
    names = [f"Entry number {i:07d}" for i in range(300)] + random_names(rng, 200, "aB", 20) + ["entry number 00000", "0123", "a", "", "ab", "ENTRY NUMBER 0000012x", "é" * 12]
    names = list(dict.fromkeys(names))
    scratch = Scratch(spark, "pairs")
    found = explore.may_join(spark.createDataFrame([(s,) for s in names], "section string"), scratch)
    expected = {(u, v) for u in names for v in names if u != v and u.lower() in v.lower()}
    assert {(r.u, r.v) for r in found.collect()} - {(u, v) for u in names for v in names if u.lower() == v.lower()} == {(u, v) for u, v in expected if u.lower() != v.lower()}
    held = spark.read.parquet(next(p for p in scratch.paths.values() if p.endswith("grams")))
    assert held.where("length(gram) = 12 and low like 'entry number%'").groupBy("gram").count().where("count = 1").count() > 100
    scratch.close()
