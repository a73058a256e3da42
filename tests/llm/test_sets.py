"""Operators that relate rows to each other: near duplicates, search, URL lists, quality, shards, packing, pipeline."""

from __future__ import annotations

import datetime
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import minhash, packing, quality, queries, sharding, topk, urlfilter, words
from factloom.plans import components, skew
from factloom.plans.scratch import Scratch, shared_folder


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, id string, n int, node string")


# ---------------------------------------------------------------- near duplicates


def shingles(text, k):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_components(rows, k, percent=80):
    """{id: (set sizes, component)} by comparing all that share a shingle."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for at, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(at)
    for at, (i, s) in enumerate(sets):
        for j, m in Counter(x for g in s for x in holders[g] if x < at).items():
            other, t = sets[j]
            if i is not None and other is not None and 100 * m >= percent * (len(s) + len(t) - m):
                a, b = root(i), root(other)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def hot_corpus():
    rng = random.Random(11)
    word = lambda: "w%d" % rng.randrange(100_000)
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for i in range(260):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12])):
            copy[rng.randrange(120)] = word()
        rows.append((1000 + i, " ".join(copy)))
    rows += [(2000 + i, " ".join(passage + [word() for _ in range(rng.randrange(5, 60))])) for i in range(150)]
    rows += [(3000 + i, " ".join(word() for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(4000 + i, "The SAME\ttext here, again and again") for i in range(50)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "é  É x y"), (8, "é É x y")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_by_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(skew, "SMALL", 0 if k == 4 else skew.SMALL)
    rows = hot_corpus()
    expected = brute_components(rows, k)
    sizes = {i: len(shingles(t, k)) for i, t in rows}
    found = minhash.near_duplicates(frame(spark, rows), shingle=k).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["component_id"], r["n_shingles"], r["kept"]) == (expected[r["doc_id"]], sizes[r["doc_id"]], expected[r["doc_id"]] == r["doc_id"])


def test_near_duplicate_edge_cases(spark):
    text = " ".join(f"a{i}" for i in range(40))
    other = " ".join(f"b{i}" for i in range(40))
    rows = [(None, text), (None, None), (9, text), (9, text), (9, other), (4, other), (7, text + " z")]
    found = minhash.near_duplicates(frame(spark, rows), shingle=5).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in found) == [(0, 0, True), (0, 0, True), (4, 4, True), (7, 4, False), (9, 4, False), (9, 4, False), (9, 4, False)]
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    kept = minhash.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "id", "n", "node"]
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 4]
    twice = minhash.keep_one(frame(spark, [(1, "a"), (1, "a"), (2, "b"), (2, "c"), (3, "b")]))
    assert sorted(r["doc_id"] for r in twice.collect()) == [1, 2]
    clash = spark.createDataFrame([(i, "a b", i + 6) for i in (1, 2)] + [(5, "c", 9), (5, "c", 9), (6, None, 3)], "doc_id long, text string, __first int")
    assert sorted((r["doc_id"], r["__first"]) for r in minhash.keep_one(clash).collect()) == [(1, 7), (5, 9), (6, 3)]


def template_pages(values):
    """Pages of one template with three slots of so many values each: all pairs are under the threshold (0.75 at most)."""
    fixed = [" ".join(f"f{i}x{j}" for j in range(7)) for i in range(4)]
    return [(100 * values**2 * a + 100 * b * values + 100 * c, f"{fixed[0]} a{a} {fixed[1]} b{b} {fixed[2]} c{c} {fixed[3]}") for a in range(values) for b in range(values) for c in range(values)]


def test_pages_of_one_template(spark, monkeypatch):
    rows = template_pages(8)
    rows += [(i + 1, t.replace("f3x6", "f3x7")) for i, t in rows[::50]] + [(i + 2, t) for i, t in rows[::70]]  # links, and copies
    seen, confirmed = [], minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, *rest: seen.append(pairs.count()) or confirmed(pairs, *rest))
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows), shingle=4).collect()}
    assert found == brute_components(rows, 4)
    assert max(seen) <= len(rows)  # bitmaps and prefixes leave hardly more than the links, of over 100,000 pairs that bands allow


def test_rarest_shingles_lose_no_pair(spark):
    """The last step alone, all nodes apart, against all pairs."""
    rng = random.Random(8)
    base = [rng.getrandbits(62) for _ in range(60)]
    own = [sorted({*rng.sample(base, rng.randrange(30, 60)), *(rng.getrandbits(62) for _ in range(rng.randrange(0, 6)))}) for _ in range(160)]
    own += [sorted({*x[: rng.randrange(len(x) - 8, len(x))], *(rng.getrandbits(62) for _ in range(rng.randrange(0, 6)))}) for x in own[:60]]
    tool = minhash.Sketcher(4, 1, 1)
    rows = [(i, len(x), x, tool.bitmap(np.array(x, np.uint64)).tolist(), i) for i, x in enumerate(own)]
    df = spark.createDataFrame(rows, "node long, n long, shingles array<long>, bits array<long>, component long")
    pairs = {tuple(sorted(r)) for r in minhash._by_rarest(df.drop("shingles"), df.select("node", "n", F.lit(0).alias("which"), "shingles"), 80, Scratch(spark, "t")).collect()}
    sets = [set(x) for x in own]
    near = {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert near <= pairs and len(near) > 20 and len(pairs) < 3 * len(near)


def test_signatures_agree_as_sets_do():
    tool = minhash.Sketcher(5)
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.8, 0.95):
        a = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
        m = int(600 * 2 * share / (1 + share))
        b = np.concatenate([a[:m], rng.integers(0, 1 << 63, 600 - m, dtype=np.uint64)])
        same = (tool.signature(np.unique(a)) == tool.signature(np.unique(b))).mean()
        assert abs(same - m / (1200 - m)) < 0.13


def test_components(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL", 0)
    edges = [(i, i + 1) for i in range(10, 60)] + [(3, 60), (100, 101), (102, 101), (7, 7)]
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()
    assert {r["node"]: r["component"] for r in got} == {**{i: 3 for i in [3, *range(10, 61)]}, 100: 100, 101: 100, 102: 100}
    assert len(got) == len({r["node"] for r in got})
    assert components.connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0
    scratch = Scratch(spark, "t")
    star = scratch.save(spark.createDataFrame([(1, i) for i in range(2, 3000)] + [(5000, 5001)], "u long, v long"), "star")
    labels = scratch.save(components.connected_components(star, scratch), "labels")
    more = scratch.save(spark.createDataFrame([(5001, 9000), (9000, 17), (9001, 9002)], "u long, v long"), "more")
    merged = {r["node"]: r["component"] for r in components.merge_components(labels, more, scratch).collect()}
    assert merged == {**{i: 1 for i in [*range(1, 3000), 5000, 5001, 9000]}, 9001: 9001, 9002: 9001}


def test_op1(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    expected = brute_components(docs, 4)
    assert {r["doc_id"]: r["component_id"] for r in minhash.op1_minhash(spark, sf_dir).collect()} == expected


# ---------------------------------------------------------------- search


def brute_top(vectors, k=10):
    out = []
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for at, (q, x) in enumerate(whole):
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, v)), i) for j, (i, v) in enumerate(whole) if j != at)[:k]  # noqa: B905
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("shard", [1 << 16, 40])
def test_top_by_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "BATCH", 3)
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    vectors += [(i, [1.0] * 6) for i in range(300, 420)]  # ties
    vectors += [(500, None), (501, [float("nan")] * 6), (502, [float("inf")] + [0.0] * 5), (503, [None] * 6), (None, [9.0] * 6), (600, [0.5]), (700, [])]
    vectors += [(800, [0.5] * 6)] * 3 + [(801, [2.0] * 6)] * 12 + [(900, [0.1] * 6), (900, [-3.0] * 6)]  # repeated ids
    df = spark.createDataFrame([(i, v, 0, 0.5) for i, v in vectors], "vec_id long, embedding array<double>, shard int, floor double")
    found = topk.top_inner_products(df, F.pmod(F.col("vec_id"), F.lit(100)) == 0)
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(vectors)
    assert topk.top_inner_products(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert topk.top_inner_products(df, F.lit(False)).count() == 0
    assert topk.top_inner_products(df.limit(4), F.col("vec_id") == 0).count() == 3


def test_few_cells_are_visited(spark, monkeypatch):
    """Vectors in far groups: a query goes to its own group's shards and hardly to others."""
    monkeypatch.setattr(topk, "SHARD", 50)
    visited, visit = [], topk._visit
    monkeypatch.setattr(topk, "_visit", lambda points, queries, *rest: visited.append(queries.count()) or visit(points, queries, *rest))
    rng = random.Random(4)
    vectors = [(i, [(20.0 if j == i % 8 else 0.0) + rng.gauss(0, 0.1) for j in range(8)]) for i in range(1600)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = topk.top_inner_products(df, F.pmod(F.col("vec_id"), F.lit(100)) == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute_top(vectors)
    assert visited[0] == 16 and visited[1] < 16 * 32 / 2


def test_huge_scores_are_ranked_exactly(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 9)
    rng = random.Random(3)
    vectors = [(i, [float(rng.randrange(-(2**50), 2**50)) for _ in range(3)] if i % 3 else [2.0**45 + i, 2.0**45, 1.0]) for i in range(60)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    cut = lambda x: max(-(2**63), min(2**63 - 1, x))
    expected = [(q, r, i, cut(s)) for q, r, i, s in brute_top(vectors)]
    found = topk.top_inner_products(df, F.col("vec_id") == 0)
    assert sorted(tuple(r) for r in found.collect()) == expected
    beyond = df.select("vec_id", F.transform("embedding", lambda x: x * 1e280).alias("embedding"))
    assert topk.top_inner_products(beyond, F.col("vec_id") == 0).count() == 10


def test_huge_components_are_exact():
    tree = topk.BallTree(np.array([1, 2]), np.array([[2.0**40, 1.0], [2.0**40, 0.0]]))
    assert list(tree.search(np.array([[2.0**20, 1.0]]), [0], 1, [-np.inf])) == [[(2**60 + 1, 1)]]


# ---------------------------------------------------------------- URL lists


def test_url_lists(spark):
    day = lambda m, d=1: datetime.date(2024, m, d)
    entries = spark.createDataFrame(
        [("Bad.com", "block", day(2)), ("bad.com", "remove", day(4)), ("ok.bad.com", "allow", day(3)), ("bad.com", "block", day(6)), ("bad.com", "allow", day(6)), (None, "block", day(1)), ("x.y", None, day(1))],
        "key string, action string, day date",
    )
    given = [
        (1, "http://bad.com/x", day(1)), (2, "HTTP://u:p@Sub.BAD.com:80/x", day(2)), (3, "https://ok.bad.com./", day(3)), (4, "http://bad.com", day(4)), (5, "http://notbad.com", day(3)),
        (6, "http://bad.com?x", day(7)), (7, None, day(3)), (8, "nonsense", day(3)), (9, "http://bad.com/", None), (2, "http://bad.com/", day(2, 15)), (None, "http://bad.com/", day(3)),
    ]
    captures = spark.createDataFrame([(*g, "k", "a") for g in given], "page_id long, url string, fetch_day date, key string, action string")
    found = sorted(((r["page_id"] or 0, r["entry"] or "", r["blocked"]) for r in urlfilter.judge(captures, entries).collect()))
    assert found == [(0, "bad.com", True), (1, "", False), (2, "bad.com", True), (2, "bad.com", True), (3, "ok.bad.com", False), (4, "", False), (5, "", False), (6, "bad.com", True), (7, "", False), (8, "", False), (9, "", False)]
    assert not any(r["blocked"] for r in urlfilter.judge(captures, entries.limit(0)).collect())
    assert urlfilter.judge(captures.limit(0), entries).count() == 0


def test_url_lists_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL", 0)
    """One host and day with half of the captures, one top-level domain with all, and that one listed."""
    day = datetime.date(2024, 5, 5)
    given = [(i, "http://hot.example.zz/p", day) for i in range(1500)] + [(2000 + i, f"http://h{i % 400}.zz/", day + datetime.timedelta(days=i % 3)) for i in range(1200)]
    entries = spark.createDataFrame([("zz", "block", day), ("hot.example.zz", "allow", day), ("h7.zz", "allow", day + datetime.timedelta(days=1)), ("zz", "remove", day + datetime.timedelta(days=2))], "key string, action string, day date")
    found = {r["page_id"]: (r["entry"], r["blocked"]) for r in urlfilter.judge(spark.createDataFrame(given, "page_id long, url string, fetch_day date"), entries).collect()}
    assert len(found) == len(given)
    for i, url, at in given:
        host = url.split("/")[2]
        expected = ("hot.example.zz", False) if host.startswith("hot") else ("h7.zz", False) if host == "h7.zz" and at > day else ("zz", True) if (at - day).days < 2 else (None, False)
        assert found[i] == expected


# ---------------------------------------------------------------- quality


def test_quality_of_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in quality.op7_quality(spark, sf_dir).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in found.items())
    test = [(found[i]["predicted"], y) for i, y in labels.items() if found[i]["held_out"]]
    assert sum(p == y for p, y in test) >= 0.95 * len(test)


def test_quality_edge_cases(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, "Some text."), (3, "!!! ### " * 5000), (3, "!!! ### " * 5000)])
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 0), (2, None)], "doc_id long, quality int")
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == 5 and all(r["score"] is not None for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 3}) == 1
    assert all(r["predicted"] == 1 for r in quality.score_quality(docs, labels.limit(0)).collect())
    assert quality.score_quality(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == 5


def test_threshold_covers_all_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = docs.select("doc_id", (F.pmod(F.hash("doc_id"), F.lit(3)) == 0).cast("int").alias("quality"))  # that texts don't tell
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for sample in (20, 30, 40):
        rows = [r for r in quality.score_quality(docs, labels, sample=sample).collect() if r["doc_id"] in marks and not r["held_out"]]
        assert len(rows) > sample
        assert abs(sum(r["score"] < quality.CUT for r in rows) - sum(marks[r["doc_id"]] == 0 for r in rows)) <= 1


def test_quality_by_brute_force(spark, sf_dir):
    """The loss over all pairs by plain gradient descent, the threshold as numpy's quantile, against the query."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    learned = [i for i in texts if i in marks and zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([quality.features(texts[i]) for i in learned], float), np.array([marks[i] for i in learned])
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    pairs = np.array([z[i] - z[j] for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0)])
    w, speed = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for _ in range(60_000):
        ahead = w + 0.995 * speed
        speed = 0.995 * speed - 0.05 * (1e-4 * ahead - (pairs / (1 + np.exp(np.clip(pairs @ ahead, -700, 700)))[:, None]).mean(axis=0))
        w = w + speed
    scores = z @ w
    cut = np.quantile(scores, (y == 0).mean())
    expected = dict(zip(learned, 1 / (1 + np.exp(-(2 * (scores - cut) / scores.std() + np.log(0.3 / 0.7)))), strict=True))
    found = {r["doc_id"]: r for r in quality.op7_quality(spark, sf_dir).collect()}
    assert set(found) == set(texts)
    assert max(abs(found[i]["score"] - s) for i, s in expected.items()) < 2e-3
    assert all(found[i]["predicted"] == (s >= 0.3) for i, s in expected.items() if abs(s - 0.3) > 2e-3)


def test_the_sample_is_of_the_smallest_hashes(spark):
    df = spark.range(3000).select("id", F.lit(1).alias("y"), F.xxhash64("id").alias("h"))
    every = [r["id"] for r in df.orderBy("h").collect()]
    for n in (1, 50, 2999, 3000, 9000):
        assert [r["id"] for r in quality.smallest(df, 3000, n)] == every[:n]
    assert [r["id"] for r in quality.smallest(df, 10**9, 50)] == every[:50]  # the cut grows until it suffices


def test_good_rows_are_those_predicted(spark, monkeypatch):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["The house is old.", "We went to see it.", "Nobody was there then."]) for _ in range(9))
    rows = [(i, good() if i % 2 else "!!! $$$ " * rng.randrange(1, 9)) for i in range(80)] + [(80, good())] * 3 + [(None, good()), (None, None), (81, ""), (82, None)]
    docs = spark.createDataFrame([(i, t, "s", 1, [0.5]) for i, t in rows], "doc_id long, text string, score string, id int, x array<double>")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(1, 1), (80, 1), (None, 0), (99, 1)], "doc_id long, quality int")
    scored = quality.score_quality(docs, labels).collect()
    expected = Counter(r["doc_id"] for r in scored if r["predicted"])
    assert len(scored) == len(rows) and expected[80] == 3 and expected[1] == 1 and expected[0] == 0
    for few in (skew.FEW_BYTES, 0):
        monkeypatch.setattr(skew, "FEW_BYTES", few)
        kept = quality.keep_good(docs, labels)
        assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == expected


def test_quantile_is_numpys(spark):
    values = np.random.default_rng(4).normal(size=30_000).round(3)
    df = spark.createDataFrame([(float(v),) for v in values], "s double")
    for share in (0.0, 0.1234, 0.5, 0.9999, 1.0):
        assert abs(quality.quantile(df, "s", len(values), share) - np.quantile(values, share)) < 1e-12


# ---------------------------------------------------------------- shards


def test_placement_balances_all_dimensions():
    rng = np.random.default_rng(1)
    demand = np.column_stack([np.ones(4000), rng.lognormal(7, 1, 4000), rng.lognormal(5, 1, 4000)])
    loads = np.array([demand[sharding.place(demand, 40) == s].sum(axis=0) for s in range(40)])
    assert (loads[:, 1].max() - loads[:, 1].min()) / loads[:, 1].mean() < 0.02
    assert (loads.max(axis=0) < 1.25 * loads.mean(axis=0)).all()


def check_shards(rows, given, shards, whole):
    assert len(rows) == len(given)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) and 0 <= s < shards for s, x in slots.items())
    if whole:
        text, place = dict(given), defaultdict(set)
        for r in rows:
            place[text[r["doc_id"]]].add(r["shard"])
        assert all(len(x) == 1 for x in place.values())


def test_shards_with_a_hot_group(spark):
    rng = random.Random(4)
    given = [(i, "x" * rng.randrange(200, 2000)) for i in range(3000)] + [(i, "the hot text " * 40) for i in range(3000, 4500)]
    rows = sharding.shard(frame(spark, given), 8).collect()
    check_shards(rows, given, 8, False)
    sizes = Counter()
    for r in rows:
        assert r["size"] == len(dict(given)[r["doc_id"]]) + 16 if r["doc_id"] % 500 == 0 else True
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.05 * sum(sizes.values()) / 8


@pytest.mark.parametrize("one_id", [None, 5])
def test_shards_with_a_hot_group_of_one_id(spark, one_id):
    rng = random.Random(6)
    given = [(one_id, "the hot text " * 30)] * 4000 + [(i, "x" * rng.randrange(100, 600)) for i in range(10, 1010)]
    rows = sharding.shard(frame(spark, given), 8).collect()
    check_shards(rows, given, 8, False)
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) < 0.05 * sum(sizes.values()) / 8


def test_placement_by_brute_force():
    """The rule, one group after the other, in plain Python."""
    rng = random.Random(9)
    demand = [[rng.random() ** 3 * 9 + 0.01 for _ in range(3)] for _ in range(150)] + [[0.5, 0.5, 0.5]] * 20
    shards, slack = 7, (0.2, 0.0, 0.2)
    full = [sum(d[j] for d in demand) / shards for j in range(3)]
    need = [[d[j] / full[j] for j in range(3)] for d in demand]
    room, expected = [[1 + s for s in slack] for _ in range(shards)], {}
    for i in sorted(range(len(need)), key=lambda i: (-max(need[i]), i)):
        fits = [s for s in range(shards) if all(room[s][j] >= need[i][j] - 1e-12 for j in range(3))]
        expected[i] = max(fits, key=lambda s: (round(sum(a * b for a, b in zip(room[s], need[i], strict=True)), 12), -s)) if fits else max(range(shards), key=lambda s: (room[s][1], -s))
        room[expected[i]] = [a - b for a, b in zip(room[expected[i]], need[i], strict=True)]
    assert sharding.place(np.array(demand), shards, slack).tolist() == [expected[i] for i in range(len(demand))]


def test_op9(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sharding.op9_sharding(spark, sf_dir).collect()
    assert len(rows) == len(docs) == len({r["doc_id"] for r in rows})
    check_shards(rows, list(docs.items()), 40, False)
    sizes, tokens = Counter(), Counter()
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        sizes[r["shard"]] += r["size"]
        tokens[r["shard"]] += len(TOKENIZER.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) < 0.1 * sum(sizes.values()) / 40
    assert max(tokens.values()) < 1.5 * sum(tokens.values()) / 40  # words only stand for tokens


def test_shards_balance_given_tokens(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, "w" * rng.randrange(1, 300), rng.randrange(1, 900)) for i in range(4000)], "doc_id long, text string, tokens long")
    count = {r["doc_id"]: r["tokens"] for r in df.collect()}
    tokens = Counter()
    for r in sharding.shard(df, 10, tokens_col="tokens").collect():
        tokens[r["shard"]] += count[r["doc_id"]]
    assert max(tokens.values()) < 1.25 * sum(tokens.values()) / 10


def test_shard_groups_and_edge_cases(spark):
    given = [(i, f"text {i % 700} " * (1 + i % 7)) for i in range(2100)]
    check_shards(sharding.shard(frame(spark, given), 10).collect(), given, 10, True)
    odd = [(None, None), (None, "a"), (1, ""), (1, ""), (2, None), (3, "é" * 50_000)]
    rows = sharding.shard(frame(spark, odd), 4).collect()
    check_shards(rows, odd, 4, False)
    assert sorted(r["size"] for r in rows) == [16, 16, 16, 16, 17, 100_016]
    assert {r["text_crc32"] for r in rows} == {0, zlib.crc32(b"a"), zlib.crc32(("é" * 50_000).encode())}
    assert sharding.shard(frame(spark, odd).limit(0), 4).count() == 0


# ---------------------------------------------------------------- packing

WORDS = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(WORDS)


def check_pieces(pieces, given, most=2048):
    own = {i: [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1] for i, t in given}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(own)
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            ids = own[i][p["start"] : p["start"] + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(own[i]) and p["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += p["length"]
        assert at == len(own[i])
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= most
    return by_sequence


def test_op10(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    sequences = check_pieces(packing.op10_packing(spark, sf_dir).collect(), docs)
    lengths = [sum(p["length"] for p in ps) for ps in sequences.values()]
    assert all(n & (n - 1) == 0 for n in lengths)  # so nothing is padded


def test_packing_edge_cases(spark):
    given = [(1, None), (2, ""), (3, "word " * 9000), (4, "É <|endoftext|> don't 12 ½\x1c x　y")]
    pieces = packing.pack(frame(spark, given), WORDS).withColumnRenamed("id", "doc_id").collect()
    check_pieces(pieces, given)
    assert all(zlib.crc32(np.array(p["piece_ids"], "<u4").tobytes()) == p["ids_crc32"] for p in pieces)
    assert packing.pack(frame(spark, [(7, "a"), (7, "a"), (None, "b")]), WORDS).count() >= 3
    assert packing.pack(frame(spark, given).limit(0), WORDS).count() == 0


@pytest.mark.parametrize("limits", [(100, 4, 30), (64, 64, 64), (50, 3, 7)])
def test_the_largest_dot_product_is_chosen(limits):
    """Whatever is taken fits if anything does, and no other that does has a larger dot product with the room left."""
    taken = []

    class Watched(packing.Packer):
        def _take(self, i):
            room = [Fraction(int(m) - u, int(m)) for m, u in zip(self.limits, self.used, strict=True)]
            share = [[Fraction(int(d), int(m)) for d, m in zip((e - s, 1, int(b[e] - b[s])), self.limits, strict=True)] for _, s, e, b in self.waiting]
            fits = [all(d <= r for d, r in zip(x, room, strict=True)) for x in share]
            score = [sum(d * r for d, r in zip(x, room, strict=True)) for x in share]
            best = max(x for x, ok in zip(score, fits, strict=True) if ok or not any(fits))
            taken.append(fits[i] or not any(fits))
            assert taken[-1] and float(best - score[i]) < 1e-12
            return super()._take(i)

    rng = random.Random(sum(limits))
    packer = Watched(*limits)
    for i in range(1200):
        n = rng.randrange(1, 120)
        packer.add(i, n, np.concatenate([[0], np.cumsum([rng.random() < 0.3 for _ in range(n)])]))
    packer.finish()
    assert len(taken) > 1000


@pytest.mark.parametrize("limits", [(100, 4, 30), (64, 64, 64), (100, 1, 100), (50, 3, 7)])
def test_all_limits_hold(limits):
    rng = random.Random(sum(limits))
    packer = packing.Packer(*limits)
    masks = {}
    for i in range(2500):
        n = rng.randrange(1, 180)
        masks[i] = np.array([rng.random() < 0.3 for _ in range(n)])
        packer.add(i, n, np.concatenate([[0], np.cumsum(masks[i])]))
    packer.finish()
    seen, used = {i: np.zeros(len(m), int) for i, m in masks.items()}, defaultdict(lambda: [0, 0, 0])
    for key, start, length, sequence, offset in packer.placed:
        assert offset == used[sequence][0]
        seen[key][start : start + length] += 1
        for d, x in enumerate((length, 1, int(masks[key][start : start + length].sum()))):
            used[sequence][d] += x
    assert all((x == 1).all() for x in seen.values())
    assert all(u <= m for v in used.values() for u, m in zip(v, limits, strict=True))


def test_loss_of_conversations(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = F.udf(lambda t: [True] * (len(TOKENIZER.encode(t, add_special_tokens=False).ids) + 1), "array<boolean>")
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", F.when(F.col("role") == "assistant", n("text")).otherwise(F.transform(n("text"), lambda x: ~x)).alias("loss"))
    pieces = packing.pack(rows, WORDS, loss_col="loss", max_loss=1024, max_segments=16).withColumnRenamed("id", "doc_id").collect()
    role = {r["conv_id"] * 1000 + r["turn"]: r["role"] for r in turns.collect()}
    sequences = check_pieces(pieces, [(r["doc_id"], r["text"]) for r in rows.collect()])
    assert all(len(ps) <= 16 and sum(p["length"] for p in ps if role[p["doc_id"]] == "assistant") <= 1024 for ps in sequences.values())


def test_words_that_do_not_come_apart():
    """A row whose word ends don't fit its words, by number or by bytes, is encoded word by word."""
    tool = words.WordTokens(WORDS)
    ids = lambda *given: np.frombuffer(b"".join(tool._plain(list(given))), "<u4")
    right = tool._plain(["abc", "xy", "d"])
    for found in (ids("abc", "x y", "d"), ids("abcx", "y", "d"), ids("ab", "cxy", "d"), ids("abc", "xy"), ids("abc", "xy", "d")[:-1]):
        assert tool._apart(["abc", "xy", "d"], found) == right
    assert tool._apart(["abc", "xy", "d"], ids("abc", "xy", "d")) == right


def test_small_stores_give_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = [sorted(map(str, packing.pack(docs, WORDS, store=store).collect())) for store in (packing.FAST, packing.LEAN, (50, 1000))]
    assert pieces[0] == pieces[1] == pieces[2]


def next_fit(examples, limits):
    """Sequences that the plain rule takes: pieces in order, a new sequence where a limit would break."""
    count, used = 1, [0, 0, 0]
    for tokens, loss in examples:
        while tokens:
            part = min(tokens, limits[0])
            share = part if loss else 0
            if used[0] + part > limits[0] or used[1] + 1 > limits[1] or used[2] + share > limits[2]:
                count, used = count + 1, [0, 0, 0]
                part = min(part, limits[2]) if loss else part
                share = part if loss else 0
            used = [used[0] + part, used[1] + 1, used[2] + share]
            tokens -= part
    return count


def test_turns_within_all_limits(spark):
    sf_dir = "/root/testdata/sf0.1"
    turns = {(r["conv_id"], r["turn"]): r for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    pieces = [{**r.asDict(), "doc_id": (r["conv_id"], r["turn"])} for r in packing.packing_turns(spark, sf_dir).collect()]
    sequences = check_pieces(pieces, [(k, r["text"]) for k, r in turns.items()])
    loss = lambda ps: sum(p["length"] for p in ps if turns[p["doc_id"]]["role"] == "assistant")
    assert all(len(ps) <= 24 and loss(ps) <= 1024 for ps in sequences.values())
    assert sum(len(ps) == 24 for ps in sequences.values()) > 5  # the limits bind
    length = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    plain = next_fit([(length[k], turns[k]["role"] == "assistant") for k in sorted(turns)], (2048, 24, 1024))
    assert len(sequences) <= plain + 12 * spark.sparkContext.defaultParallelism  # a task cuts its last sequence into up to 11


@pytest.mark.parametrize(("limits", "most"), [((2048, 16, 700), 0.97), ((1024, 64, 1024), 0.97), ((2048, 8, 2048), 1.03)])  # if only segments bind it is no better
def test_dot_products_against_next_fit(limits, most):
    rng = random.Random(1)
    examples = [(int(rng.lognormvariate(5, 1)) + 1, rng.random() < 0.4) for _ in range(4000)]
    packer = packing.Packer(*limits)
    for i, (n, loss) in enumerate(examples):
        packer.add(i, n, None if loss else np.zeros(n + 1, np.int64))
    packer.finish()
    assert packer.sequence < most * next_fit(examples, limits) + 12


def test_loss_of_rows(spark):
    rows = spark.createDataFrame([(1, "word " * 50, True), (2, "word " * 50, False), (3, "word " * 50, None), (4, None, False)], "doc_id long, text string, loss boolean")
    pieces = packing.pack(rows, WORDS, loss_col="loss", max_tokens=100, max_loss=20).collect()
    used = defaultdict(Counter)
    for p in pieces:
        used[p["sequence_id"]]["tokens"] += p["length"]
        used[p["sequence_id"]]["loss"] += p["length"] * (p["id"] in (1, 3))
    assert sum(u["tokens"] for u in used.values()) == 51 * 3 + 1 and all(u["loss"] <= 20 and u["tokens"] <= 100 for u in used.values())


# ---------------------------------------------------------------- the pipeline and all queries


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "packing"]
    scratch, before = Scratch(spark, "t"), {r["doc_id"]: r["text"] for r in docs.collect()}
    predicted = {r["doc_id"]: r["predicted"] for r in quality.op7_quality(spark, sf_dir).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality":
            assert set(after) == {i for i, p in predicted.items() if p}
            assert sum(labels[i] for i in after if i in labels) >= 0.97 * sum(labels.values())
        elif name == "near_dedup":
            expected = brute_components(list(before.items()), 5)
            assert set(after) == {i for i, c in expected.items() if i == c}
        else:
            assert set(after) == set(before) and not any("token = \"" in t for t in after.values())
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        before = after
    check_pieces(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect(), list(before.items()))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == set(before)


SHAPE = "doc_id long, text string, lang string, source string, n_chars long, id string, x int, component string, node long, __first long, key string"


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns named as the operators' own."""
    good = "The old house stood by the river. Nobody went there, and it was quiet. "
    given = [(1, None), (2, ""), (3, " \n\t"), (4, good), (4, good), (5, good), (6, good + 'token = "abcdef012345"'), (7, good * 900 + "AKIA" + "Z9" * 10), (8, "word"), (8, "other"), (None, good), (None, None)]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "i", n, "c", 5, 77, "k") for n, (i, t) in enumerate(given)] + [(9, good * 2, *[None] * 9), (None,) * 11], SHAPE)


def plain_rows(df):
    return Counter(map(str, df.collect()))


def test_every_stage_on_odd_documents(spark, sf_dir):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
    stages = dict(corpus_pipeline.STAGES)
    scored = Counter((r["doc_id"], r["predicted"]) for r in quality.score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect())
    kept = stages["quality"](spark, docs, sf_dir)
    assert Counter((r["doc_id"], 1) for r in kept.collect()) == Counter({k: n for k, n in scored.items() if k[1]})
    assert not plain_rows(kept) - plain_rows(docs)
    kept = stages["near_dedup"](spark, docs, sf_dir)
    # 6 is its group's own: what follows the sentences makes it too different; 7 and 9 have the set of 4, but for the words at the repeats
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 8, None, None, None] + sorted(i for i, c in brute_components([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in (4, 5, 6, 7, 9)], 5).items() if i == c))
    assert not plain_rows(kept) - plain_rows(docs)
    masked = stages["secrets"](spark, docs, sf_dir)
    before, after = docs.orderBy("x").collect(), masked.orderBy("x").collect()
    for a, b in zip(before, after, strict=True):
        if a["doc_id"] in (6, 7):
            assert b["text"] != a["text"] and ("[assign]" in b["text"] or "[access]" in b["text"]) and b["n_chars"] == len(b["text"])
        else:
            assert a == b
    packed = stages["packing"](spark, docs, sf_dir)
    tokens = Counter()
    for r in packed.collect():
        tokens[r["doc_id"]] += r["length"]
    own = Counter()
    for r in before:
        own[r["doc_id"]] += len(TOKENIZER.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    assert tokens == own


def test_pipeline_keeps_token_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    pieces = corpus_pipeline.packed(spark, docs, sf_dir).collect()
    assert len({r["doc_id"] for r in pieces}) == 20
    for r in pieces:
        assert len(r["piece_ids"]) == r["length"] and zlib.crc32(np.array(r["piece_ids"], "<u4").tobytes()) == r["ids_crc32"]


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == shared_folder(spark)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{file}')")
    found, expected = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    plain = lambda v: "None" if v is None or isinstance(v, float) and math.isnan(v) else str(v)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert sorted(found.columns) == sorted(expected.columns) and rows(found) == rows(expected)
