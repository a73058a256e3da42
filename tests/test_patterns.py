"""Graph patterns against an evaluator that goes row by row over compatible mappings."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from factloom.operators import kb, patterns

ROWS = [("a", "n", "A"), ("b", "n", "B"), ("a", "v", "1"), ("b", "v", "9"), ("b", "z", "B"), ("a", "q", "k"), ("k", "r", "K")]


def store(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string").repartition(2)


# ---------------------------------------------------------------- row by row


def agree(a, b):
    return all(a[v] == b[v] for v in a.keys() & b.keys())


def plain_pairs(rows, path, nodes):
    if isinstance(path, patterns.Term):
        return [(s, o) for s, p, o in rows if p == path.value]
    kind, *parts = path
    own = [plain_pairs(rows, x, nodes) for x in parts]
    if kind == "^":
        return [(o, s) for s, o in own[0]]
    if kind == "|":
        return own[0] + own[1]
    if kind == "/":
        return [(s, o) for s, x in own[0] for y, o in own[1] if x == y]
    found = set(own[0])
    while kind != "?" and (more := {(s, o) for s, x in found for y, o in own[0] if x == y} - found):
        found |= more
    return sorted(found if kind == "+" else found | {(x, x) for x in nodes})


def plain_truth(test, row):
    kind, *given = test
    if kind in ("and", "or"):
        one, two = (plain_truth(x, row) for x in given)
        sure = False if kind == "and" else True
        return sure if sure in (one, two) else None if None in (one, two) else not sure
    if kind == "not":
        one = plain_truth(given[0], row)
        return None if one is None else not one
    a, b = (row.get(x.variable) if x.variable else x.value for x in (given[0], given[-1]))
    if kind == "BOUND":
        return a is not None
    if a is None or b is None:
        return None
    if kind == "STRSTARTS":
        return a.startswith(b)
    number = lambda x: float(x) if x.lstrip("-").replace(".", "", 1).isdigit() else None
    x, y = number(a), number(b)
    if any(t.number for t in given):
        if x is None or y is None:
            return None
        a, b = x, y
    elif all(t.variable for t in given) and x is not None and y is not None:
        a, b = x, y
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[kind]


def plain_group(rows, elements, filtered=True):
    nodes = {x for s, _, o in rows for x in (s, o)}
    now = [{}]
    for e in elements:
        if e[0] == "triple":
            _, s, p, o = e
            if isinstance(p, patterns.Term):
                found = [{t.variable: x for t, x in zip((s, p, o), row, strict=True) if t.variable} for row in rows if all(t.variable or t.value == x for t, x in zip((s, p, o), row, strict=True)) and len({(t.variable, x) for t, x in zip((s, p, o), row, strict=True) if t.variable}) == len({t.variable for t in (s, p, o) if t.variable})]
            else:
                fixed = {t.value for t in (s, o) if t.value}
                found = [{t.variable: x for t, x in zip((s, o), pair, strict=True) if t.variable} for pair in plain_pairs(rows, p, nodes | fixed) if all(t.variable or t.value == x for t, x in zip((s, o), pair, strict=True)) and (s.variable != o.variable or s.variable is None or pair[0] == pair[1])]
            now = [a | b for a in now for b in found if agree(a, b)]
        elif e[0] == "union":
            found = [x for part in e[1] for x in plain_group(rows, part)]
            now = [a | b for a in now for b in found if agree(a, b)]
        elif e[0] == "option":
            found, tests = plain_group(rows, e[1], False), [x[1] for x in e[1] if x[0] == "filter"]
            out = []
            for a in now:
                own = [a | b for b in found if agree(a, b) and all(plain_truth(x, a | b) for x in tests)]
                out += own or [a]
            now = out
        elif e[0] == "minus":
            found = plain_group(rows, e[1])
            now = [a for a in now if not any(agree(a, b) and a.keys() & b.keys() for b in found)]
    for e in elements:
        if e[0] in ("present", "absent"):
            found, tests = plain_group(rows, e[1], False), [x[1] for x in e[1] if x[0] == "filter"]
            now = [a for a in now if any(agree(a, b) and all(plain_truth(x, a | b) for x in tests) for b in found) == (e[0] == "present")]
        elif e[0] == "filter" and filtered:
            now = [a for a in now if plain_truth(e[1], a)]
    return now


def both(spark, rows, where):
    """Spark's bindings and the plain ones, as counts of rows."""
    found = kb.match_patterns(store(spark, rows), where)
    reader = patterns._Reader(where)
    names = {v: n for n, v in reader.names.items()}
    want = Counter(frozenset((names[v], x) for v, x in row.items()) for row in plain_group(rows, reader.group("")))
    got = Counter(frozenset((k, v) for k, v in row.asDict().items() if v is not None) for row in found.collect())
    return got, want


@pytest.mark.parametrize(
    "where",
    [
        "?s <n> ?n . OPTIONAL { ?s <v> ?v . FILTER(?v > 5) }",
        "{ ?s <n> ?n } UNION { ?s <v> ?v } . ?s <n> ?n",
        "?s <n> ?n . { ?s <q> ?x } UNION { ?s <z> ?n } OPTIONAL { ?x <r> ?y }",
        "?s <n> ?n OPTIONAL { ?s <q> ?x } OPTIONAL { ?x <r> ?y } FILTER(!BOUND(?y) || ?y = \"K\")",
        "{ ?s <q> ?x } UNION { ?s <z> ?n } . ?x <r> ?y",
        "?s <n> ?n MINUS { ?s <z> ?n }",
        "?s <n> ?n OPTIONAL { ?s <q> ?x } MINUS { ?x <r> ?y }",
        "?s <n> ?n OPTIONAL { ?s <q> ?x } FILTER NOT EXISTS { ?x <r> ?y }",
        "?s <v> ?v FILTER EXISTS { ?s <z> ?n FILTER(?v > 5) }",
        "?s <n> ?n FILTER NOT EXISTS { ?s <v> ?v FILTER(?v > 5 && ?n != \"C\") }",
        "?s <n> ?n . { ?s <v> ?v FILTER(?n = \"A\") } UNION { ?s <v> ?v FILTER(?v < 5) }",
        "?s <n> ?n ; <v> ?v . FILTER(?v >= 1 && (REGEX(?n, \"^b\", \"i\") || STRSTARTS(?n, \"A\")))".replace("REGEX(?n, \"^b\", \"i\") || ", ""),
        "?s <n>|<z> ?n",
        "?s (<q>/<r>)|<n> ?n",
        "?x ^<q> ?s",
        "?s <q>? ?x . ?s <n> ?n",
        "<a> <q>/<r> ?y . ?s <r> ?y",
        "?s ?p ?o . ?s <n> \"A\"",
        "?s <n> ?n ; <n> ?m ; <v> ?v",
        "?s <z> ?n ; <n> ?n",
    ],
)
def test_patterns_by_compatible_mappings(spark, where):
    got, want = both(spark, ROWS, where)
    assert got == want


def test_values_of_the_three_that_lost_rows(spark):
    t = store(spark, ROWS)
    rows = lambda where: sorted(tuple(r) for r in kb.match_patterns(t, where).na.fill("-").collect())
    assert rows("?s <n> ?n . OPTIONAL { ?s <v> ?v . FILTER(?v > 5) }") == [("a", "A", "-"), ("b", "B", "9")]
    assert rows("{ ?s <n> ?n } UNION { ?s <v> ?v } . ?s <n> ?n") == [("a", "A", "-"), ("a", "A", "1"), ("b", "B", "-"), ("b", "B", "9")]
    assert rows("?s <n> ?n . { ?s <q> ?x } UNION { ?s <z> ?n } OPTIONAL { ?x <r> ?y }") == [("a", "A", "k", "K"), ("b", "B", "k", "K")]


def random_pattern(rng, depth=2):
    """A group whose parts mostly share variables."""
    name = lambda: f"?{rng.choice('xyz')}"
    triple = lambda: f"{name()} <{rng.choice('pqr')}> {name() if rng.random() < 0.8 else '<' + rng.choice('abc') + '>'} ."
    test = lambda: rng.choice([f"FILTER({name()} != \"{rng.choice('abc')}\")", f"FILTER(!BOUND({name()}) || {name()} < 3)", f"FILTER({name()} = {name()})", f"FILTER(BOUND({name()}))"])
    out = [triple()]
    for _ in range(rng.randint(0, 2)):
        kind = rng.random()
        if kind < 0.3 or depth == 0:
            out.append(triple())
        elif kind < 0.5:
            out.append(f"OPTIONAL {{ {random_pattern(rng, depth - 1)} }}")
        elif kind < 0.7:
            out.append(f"{{ {random_pattern(rng, depth - 1)} }} UNION {{ {random_pattern(rng, depth - 1)} }}")
        elif kind < 0.8:
            out.append(f"MINUS {{ {random_pattern(rng, depth - 1)} }}")
        elif kind < 0.9:
            out.append(f"FILTER {rng.choice(['', 'NOT '])}EXISTS {{ {triple()} }}")
        else:
            out.append(test())
    if rng.random() < 0.3:
        out.append(test())
    return " ".join(out)


def test_random_patterns(spark):
    """Those that are refused share no variable; all others agree."""
    rng = random.Random(11)
    agreed = 0
    for _ in range(60):
        rows = sorted({(rng.choice("abcd"), rng.choice("pqr"), rng.choice("abcd15")) for _ in range(9)})
        where = random_pattern(rng)
        try:
            got, want = both(spark, rows, where)
        except ValueError as e:
            assert "shares no variable" in str(e) or "no pattern binds" in str(e), where
            continue
        assert got == want, where
        agreed += 1
    assert agreed > 25


@pytest.mark.parametrize("where", ["?x <p>+ ?y", "?x <p>* ?y", "<c0> <p>+ ?y", "?x <p>+ <c9>", "<c0> <p>* <c0>", "?x (<p>|<q>)+ ?y", "?x (<p>/<q>)* ?y", "?x ^<p>+ ?y", "<none> <p>* ?y", "?x <p>+ ?x"])
def test_closures(spark, where):
    """Chains, cycles, a hub."""
    rows = [(f"c{i}", "p", f"c{i + 1}") for i in range(13)] + [("d0", "p", "d1"), ("d1", "p", "d2"), ("d2", "p", "d0"), ("c3", "q", "c9"), ("c4", "q", "d0")]
    rows += [(f"l{i}", "p", "hub") for i in range(20)] + [("hub", "p", f"m{i}") for i in range(20)]
    got, want = both(spark, rows, where)
    assert got == want


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange ")


def test_star_is_one_grouping(spark):
    """Five properties of a subject: no join, and no exchange for each; many values of one are joined."""
    rows = [(f"s{i}", f"p{k}", f"v{i % 7}_{k}") for i in range(50) for k in range(5)]
    where = "?s " + " ; ".join(f"<p{k}> ?o{k}" for k in range(5))
    found = kb.match_patterns(store(spark, rows), where)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString() and exchanges(found) < 5 and found.count() == 50
    rows += [("s1", "p2", "more"), ("s1", "p3", "more"), ("s1", "p3", "yet more"), ("s2", "p0", "v2_0")]
    got, want = both(spark, rows, where)
    assert got == want and sum(got.values()) == 49 - 1 + 6 + 2


def test_order_of_joins():
    """The small parts come first, and only parts that share a variable meet."""
    parts = [(1e6, {"a": 1e6, "b": 1e3}), (1e6, {"b": 1e3, "c": 1e6}), (10, {"c": 10, "d": 10})]
    assert patterns.join_order(parts) in ((0, (1, 2)), ((1, 2), 0), ((2, 1), 0), (0, (2, 1)))
    many = [(float(i + 1), {f"v{i}": 1.0, f"v{i + 1}": 1.0}) for i in range(14)]

    def leaves(tree):
        return [tree] if isinstance(tree, int) else leaves(tree[0]) + leaves(tree[1])

    assert sorted(leaves(patterns.join_order(many))) == list(range(14))
    with pytest.raises(ValueError, match="shares no variable"):
        patterns.join_order([(1, {"a": 1}), (1, {"b": 1})])


@pytest.mark.parametrize("bad", ["?s <n>", "?s <n> ?o FILTER(?s", "OPTIONAL { ?s <n> ?o }", "?s <n> ?o . ?t <q> ?u", "?s ?p+ ?o", "SELECT ?s", "?s <n> ?o }", "?s <n> ?o FILTER(BOUND(<a>))", "?s x:n ?o", "?s <n> ?o OPTIONAL { ?t <q> ?u }"])
def test_what_is_refused(spark, bad):
    with pytest.raises(ValueError):
        kb.match_patterns(store(spark, ROWS), bad)


def test_empty_store_and_nulls(spark):
    assert kb.match_patterns(store(spark, []), "?s <n> ?n ; <v> ?v OPTIONAL { ?s <q>+ ?x }").collect() == []
    rows = [*ROWS, (None, "n", "A"), ("a", "n", None), ("a", None, "A")]
    assert kb.match_patterns(store(spark, rows), "?s <n> ?n").count() == 2
