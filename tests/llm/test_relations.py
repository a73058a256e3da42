"""The n-gram join, whitening and the repair of conversations, against brute force."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from factloom.llm import ngramjoin, repair, whitening
from tests.llm.test_sets import brute_components, frame, shingles

ODD = [(None, "a b c d e f"), (None, None), (900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "one two three"), (906, "x" * 100_000), (907, "x" * 100_000), (908, " ".join(["very long"] * 30_000))]


def joined(spark, rows, percent=80):
    found = ngramjoin.similar_documents(frame(spark, rows), percent=percent).collect()
    assert len(found) == len(rows)
    return found


def mutated(rng, words, edits, vocabulary):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return out


@pytest.mark.parametrize("percent", [80, 60])
def test_ngram_join_by_brute_force(spark, percent):
    """Near copies about the threshold, chains of them, a common passage, and odd rows."""
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 160))]
        if rng.random() < 0.5:
            base = base + passage
        for _ in range(rng.randint(1, 6)):
            rows.append((i * 7 % 1009, " ".join(base)))
            i += 1
            base = mutated(rng, base, rng.randint(0, max(1, len(base) // 40)), vocabulary)
    rows += ODD + [(3, "the very same"), (3, "quite another one"), (950, "the VERY same")]
    found = joined(spark, rows, percent)
    want = brute_components(rows, 5, percent)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == want
    assert all(r.component_id is None for r in found if r.doc_id is None)
    assert sorted(r.n_shingles for r in found) == sorted(len(shingles(t, 5)) for _, t in rows)


def test_ngram_join_template_pages(spark):
    """Pages of one template share most shingles: some are linked, most stay just under the threshold."""
    rng = random.Random(5)
    head = [f"t{i}" for i in range(40)]
    rows = [(i, " ".join(head + [f"a{rng.randrange(12)}", f"b{rng.randrange(12)}", "mid", "dle", "of", "it"] + [f"c{rng.randrange(400)}", f"d{rng.randrange(400)}"])) for i in range(220)]
    assert {r.doc_id: r.component_id for r in joined(spark, rows)} == brute_components(rows, 5)


def test_ngram_join_empty(spark):
    assert ngramjoin.similar_documents(frame(spark, [])).collect() == []
    assert [r.component_id for r in joined(spark, [(4, None), (None, "")])] in ([4, None], [None, 4])


def test_prefixes_are_exact():
    """Whatever the order, similar sets share as many tokens of their prefixes as the filters ask for."""
    rng = random.Random(2)
    for i in range(400):
        n, share = rng.randint(1, 90), (ngramjoin.FIRST, ngramjoin.SECOND)[i % 2]
        x = set(rng.sample(range(400), n))
        y = set(list(x)[: rng.randint(max(1, n - 12), n)]) | set(rng.sample(range(400, 500), rng.randint(0, 9)))
        if 100 * len(x & y) < 80 * len(x | y):
            continue
        order = list(range(500))
        rng.shuffle(order)
        place = {t: i for i, t in enumerate(order)}
        slack = lambda k: k - ngramjoin.needed(k, 80)
        more = lambda k: int(np.ceil(slack(k) * share)) + 1  # noqa: B023, E731
        head = lambda s: set(sorted(s, key=place.get)[: slack(len(s)) + more(len(s))])  # noqa: B023, E731
        for s in (x, y):
            assert len(head(x) & head(y)) >= more(ngramjoin.needed(len(s), 80))


# ---------------------------------------------------------------- whitening


def plain_whitening(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), c @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


@pytest.mark.parametrize("columns", [3, 5, 32])
def test_whitening_by_numpy(spark, columns):
    rng = np.random.default_rng(columns)
    vectors = (rng.normal(size=(300, 11)) @ rng.normal(size=(11, 11))).round(3)
    df = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, id string, n int").repartition(5)
    found = whitening.whiten(df, columns=columns).toPandas()
    deviation, white, explained = plain_whitening(np.array([r.embedding for r in df.orderBy("vec_id").collect()]))
    got = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((got * white).sum(axis=0))
    assert np.allclose(got * sign, white, atol=1e-9)
    first = found[found.component == 1].sort_values("vec_id")
    assert first.deviation.tolist() == deviation.tolist() and set(found.n) == {300}
    assert np.allclose(found[found.vec_id == 0].sort_values("component").explained, explained, rtol=1e-9)
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-9


def test_whitening_of_odd_rows(spark):
    good = [(1, [1.0, 2.0, 3.0]), (None, [4.0, 1.0, 0.0]), (7, [0.0, 0.0, 9.0]), (7, [0.0, 0.0, 9.0]), (8, [3.0, 5.0, -9.0])]
    bad = [(2, None), (None, [0.5, float("nan"), 1.0]), (3, [1.0, None, 2.0]), (4, []), (5, [float("inf"), 1.0, 1.0]), (6, [1.0]), (9, [1e300, 0.0, 0.0])]
    kind = "vec_id long, embedding array<double>"
    found = whitening.whiten(spark.createDataFrame(good + bad, kind)).collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in found if r.component == 1) == sorted((i is None, i) for i, _ in good)
    assert {r.n for r in found} == {5} and {r.component for r in found} == {1, 2, 3}
    deviation, _, _ = plain_whitening([v for _, v in good])
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(deviation.tolist())
    one = whitening.whiten(spark.createDataFrame(good[:1], kind)).collect()
    assert [(r.whitened, r.identity_error, r.deviation) for r in one] == [(0.0, 1.0, 0)] * 3
    assert whitening.whiten(spark.createDataFrame(bad[:1], kind)).collect() == []
    huge = whitening.whiten(spark.createDataFrame([(i, [i * 1e11, float(i * i)]) for i in range(40)], kind)).collect()
    assert {r.deviation for r in huge if r.vec_id != 39} == {None} or all(r.deviation is None or r.deviation >= 0 for r in huge)


# ---------------------------------------------------------------- repair


def plain_solve(letters):
    """Cheapest first over (cost, audit): (role initial, fault) of each row, insertions anywhere."""
    heap, done = [(0, "", 0, 0)], set()
    follow = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(letters) and q in (0, 3):
            return cost, audit
        if (i, q) in done:
            continue
        done.add((i, q))
        want = "a" if q == 2 else "u"
        heapq.heappush(heap, (cost + 5, audit + "I", i, follow[q, want]))
        if i < len(letters):
            role, fault = letters[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q))
            if fault not in ("blank", "duplicate"):
                stays = 5 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + stays + 1, audit + "R", i + 1, follow[q, want]))
                if (q, role) in follow:
                    heapq.heappush(heap, (cost + stays, audit + "K", i + 1, follow[q, role]))
    raise AssertionError


def plain_repair(rows):
    """{conv_id: result} of rows (conv_id, turn, role, text), one after another."""
    out = {r[0]: [] for r in rows}
    show = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        role = "user" if fault == 4 else role
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    found = {}
    for conv, given in out.items():
        name = "n" if conv is None else f"c{conv}"
        what = lambda r: hashlib.md5(f"{name}\n{len(r[1])}\n{r[1]}{r[2]}".encode()).hexdigest()  # noqa: B023, E731
        given.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:1], what(r)))
        seen, letters = set(), []
        for _, role, text in given:
            kept = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None
            seen.add((role, text))
            letters.append((role[:1], fault))
        cost, audit = plain_solve(letters)
        lines, q, i = [], 0, 0
        for edit in audit:
            want = "assistant" if q == 2 else "user"
            if edit == "D":
                i += 1
                continue
            if edit == "I":
                lines.append(f"{want}:")
            else:
                role = given[i][1] if edit == "K" else want
                lines.append(f"{role}:{given[i][2]}")
                i += 1
            q = 1 if edit == "K" and role[0] == "s" else 2 if want == "user" else 3
        turns = {t for t, _, _ in given if t is not None}
        initials = [r for r, _ in letters]
        found[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(sum(f == k for _, f in letters) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),  # noqa: B905
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return found


def test_solve_by_cheapest_first():
    rng = random.Random(4)
    faults = {0: None, 1: "truncated", 2: "blank"}
    kinds = (repair._AS_IS, repair._CUT, repair._GONE)
    for n in [0, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, *[rng.randint(4, 30) for _ in range(120)], 200]:
        kind, role = [rng.choice([0, 0, 0, 1, 2]) for _ in range(n)], [rng.randrange(4) for _ in range(n)]
        signature = "".join(kinds[k][r] for k, r in zip(kind, role, strict=True))
        cost, audit, edits = repair.solve(signature)
        assert (cost, audit) == plain_solve([("suao"[r], faults[k]) for k, r in zip(kind, role, strict=True)])
        assert len(re.findall("[kuad]", edits)) == n
        shown = [role for role, e in zip(signature, re.findall("[kuad]", edits), strict=True) if e == "k"]
        assert all(x in "sua" for x in shown)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, conv string, at string")


@pytest.mark.parametrize("section,piece", [(20_000, 256), (40, 8)])
def test_repair_by_brute_force(spark, section, piece):
    """Odd rows, ties, copies, and a conversation over several sections."""
    rng = random.Random(section)
    texts = ["Yes.", "No", "", " \t", None, "What?", "a.b", "z" * 50_000, "é!", "...", "Fine.\n"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "user"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, None, "user", "hi."), (None, 3, "assistant", "ho."), (77, None, "user", "q?"), (77, None, "system", "s."), (77, 5, None, None), (78, 10**18, "user", "u."), (78, -(10**18), "assistant", "a.")]
    rows += [(80, t, ("user", "assistant")[t % 2], f"text {t % 190}.") for t in range(400)]
    rows += [(81, 1, "user", "the same.")] * 90 + [(81, 2, "assistant", "and the same.")] * 3
    rng.shuffle(rows)
    audit, repaired = repair.repair(conversations(spark, rows), section, piece)
    found = audit.collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = {r.conv_id: tuple(r[c] for c in names) for r in found}
    want = plain_repair(rows)
    assert len(found) == len(want) and got == want
    whole = defaultdict(list)
    for r in repaired.orderBy("conv", "at").collect():
        whole[r.conv_id].append(r.text)
    assert all(hashlib.sha256("\n".join(x).encode()).hexdigest() == got[c][-1] for c, x in whole.items())


def test_repair_of_nothing(spark):
    assert repair.repair(conversations(spark, []))[0].collect() == []
    dropped = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    (row,) = repair.repair(conversations(spark, [(*dropped, "user", "gone.")]))[0].collect()
    assert tuple(row)[:8] == (dropped[0], 0, 0, 0, 0, 0, 0, "") and row.repaired_sha256 == hashlib.sha256(b"").hexdigest()
