"""Rows joined to headers and summary rows, against their rules in plain Python on random tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as fn
from factloom.operators.refine import refine
from factloom.operators.rows import table_rows
from factloom.sources import pages as scan
from factloom.sources.grid import as_number, number_text

SHAPE = "page_id long, status string, headers array<string>, header_grid array<array<string>>, data_raw array<string>, headers_raw array<string>, data array<array<struct<links:array<string>,text:string,num:double,shown:string>>>"


def cell(x):
    links, text = ([x[1:]], None) if x.startswith("@") else ([], x)
    number = None if text is None else as_number(text)
    return {"links": links, "text": None if number is not None else text, "num": number, "shown": None if number is None else number_text(number)}


def run(spark, tables, mode="compat", **options):
    """For each (headers, data): its rows as {header: value}, and which are removed."""
    rows = [(i, "OK", headers, [headers], [], [], [[cell(x) for x in row] for row in data]) for i, (headers, data) in enumerate(tables)]
    found = {r.page_id: r.rows for r in table_rows(spark.createDataFrame(rows, SHAPE), mode, **options).collect()}
    assert all([x.row_ord for x in found[i]] == list(range(len(found[i]))) for i in found)
    return [([{c.header: c.value for c in x.cells} for x in found[i]], [x.removed for x in found[i]]) for i in range(len(tables))]


def shown(x):
    return x[1:] if x.startswith("@") else x if as_number(x) is None else number_text(as_number(x))


def plain_rows(headers, data, mode):
    width = len(headers)
    if mode == "clean":
        return [{h: shown(x) for h, x in zip(headers, row[:width], strict=False)} for row in data]
    pieces = [row[k : k + width] for row in data for k in range(0, len(row), width)]
    whole = [i for i, p in enumerate(pieces) if len(p) == width]
    out = []
    for i in range(len(pieces)):
        first = max((w + 1 for w in whole if w < i), default=0)
        last = min((w for w in whole if w >= i), default=len(pieces) - 1)
        out.append({h: shown(x) for p in pieces[first : last + 1] for h, x in zip(headers, p, strict=False)})
    return out


def letters(text):
    plain = text.replace(" ", "")
    return [c.lower() for i, c in enumerate(plain) if c != c.lower() or c not in plain[:i].lower()]


def distance(a, b):
    x, y = letters(a), letters(b)
    return len([c for c in x if c not in y]) + len([c for c in y if c not in x])


def plain_removed(rows):
    removed, totals, t = [], {}, 0
    while t + len(removed) < len(rows):
        d = len(removed)
        looked, kept, left = rows[t + d], t - d, len(rows) - d
        matches = 0
        for h, x in looked.items():
            number = as_number(x)
            if number is None:
                continue
            total = totals.get(h)
            same = total is not None and (number == total or kept and number_text(number) == number_text(total / kept))
            if same and (kept > 1 or left <= 2):
                matches += 1
            else:
                totals[h] = number + (total or 0.0)
        if matches >= 2:
            now, above = rows[t], rows[max(i for i in range(t) if i not in removed)]
            if now.keys() <= above.keys() and any(as_number(x) is None and as_number(above[h]) is None and distance(x, above[h]) >= 7 for h, x in now.items()):
                removed.append(t)
        t += 1
    return [i in removed for i in range(len(rows))]


NAMES = ["Boston", "Chicago Bulls", "Bulls", "Grand total of all", "-", "the Others", "@a_link", "", "Mean of the games"]


def random_table(rng):
    """Tables in which sums and means turn up, rows are long or short, and headers repeat."""
    width = rng.randint(1, 5)
    headers = [rng.choice("ABCDEFG") if rng.random() < 0.3 else f"H{i}" for i in range(width)]
    data, sums = [], [0] * width
    for i in range(rng.randint(1, 9)):
        kind = rng.random()
        if i and kind < 0.35:
            row = [str(s) if rng.random() < 0.6 else str(s / i) for s in sums]
        else:
            row = [str(rng.choice([0, 1, 2, 3, 2.5, -4])) for _ in range(width)]
            sums = [s + float(x) for s, x in zip(sums, row, strict=True)]
        row[0] = rng.choice(NAMES)
        if rng.random() < 0.2:
            row[-1] = rng.choice([*NAMES, "nan", "1e3", "1,0"])
        if rng.random() < 0.2:
            row = row[: rng.randint(1, width)] if rng.random() < 0.6 else row + rng.choices(["x", "7", "y z"], k=rng.randint(1, 7))
        data.append(row)
    return headers, data


@pytest.mark.parametrize("mode", ["compat", "clean"])
def test_random_tables(spark, mode):
    rng = random.Random(17)
    tables = [random_table(rng) for _ in range(1500)]
    found = run(spark, tables, mode)
    seen = 0
    for (headers, data), (rows, removed) in zip(tables, found, strict=True):
        want = plain_rows(headers, data, mode)
        assert rows == want and list(map(list, rows)) == list(map(list, want)), (headers, data)
        assert removed == plain_removed(want), (headers, data)
        seen += sum(removed)
    assert seen > 50


def test_rows_by_example(spark):
    sums = [["Boston", "10", "5"], ["Chicago Bulls", "20", "7"], ["-", "30", "12"]]
    three = ["Team", "G", "PTS"]
    short, long, named, beside, total, near, behind, mean = run(
        spark,
        [
            (["A", "B"], [["1", "2"], ["3"], ["4", "5"]]),
            (["A", "B"], [["1", "2", "3"]]),
            (["A", "A"], [["x", "y"]]),
            (["K1"], [["K1", "v1"], ["K2", "v2"]]),
            (three, sums),
            (three, [sums[0], ["Bulls", "20", "7"], sums[2]]),
            (three, [*sums, ["Somebody else", "60", "24"], ["And one more", "1", "2"]]),
            (three, [*sums[:2], ["All of them", "15", "6"]]),
        ],
    )
    assert short[0] == [{"A": "1.0", "B": "2.0"}, {"A": "4.0", "B": "5.0"}, {"A": "4.0", "B": "5.0"}]
    assert long[0] == [{"A": "1.0", "B": "2.0"}, {"A": "3.0"}] and named[0] == [{"A": "y"}]
    assert beside[0] == [{"K1": "K1"}, {"K1": "v1"}, {"K1": "K2"}, {"K1": "v2"}]
    assert total[1] == [False, False, True] and near[1] == [False, False, False]
    assert behind[1] == [False, False, True, False, False] and mean[1] == [False, False, True]
    assert run(spark, [(["A", "B"], [["1", "2", "3"]])], "clean")[0][0] == [{"A": "1.0", "B": "2.0"}]
    assert run(spark, [(three, sums)], drop_summaries=False)[0][1] == [False] * 3
    assert distance("-", "Chicago Bulls") == 11 and distance("AA", "") == 2


def test_letter_distances(spark):
    rng = random.Random(3)
    pairs = [tuple("".join(rng.choice("aAbBcC dé1-") for _ in range(rng.randrange(12))) for _ in range(2)) for _ in range(400)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(r["d"] == distance(r["a"], r["b"]) for r in df.select("a", "b", fn.letter_distance(F.col("a"), F.col("b")).alias("d")).collect())


def test_long_tables(spark):
    """A table of many rows, of which many are short, is a fold over arrays still."""
    data = [[f"n{i}", str(i), str(2 * i)] if i % 3 else [f"n{i}"] for i in range(4000)]
    (rows, removed), (_, none) = run(spark, [(["A", "B", "C"], data), (["A", "B", "C"], data[:1])])
    want = plain_rows(["A", "B", "C"], data, "compat")
    assert rows == want and removed == plain_removed(want) and none == [False]


@pytest.mark.parametrize("mode", ["compat", "clean"])
def test_tables_meet_python_once(spark, mode):
    page = spark.createDataFrame([(1, "P", "<table class='wikitable'><tr><th>A</th></tr><tr><td>1</td></tr></table>")], "page_id long, resource string, html string")
    plan = table_rows(refine(scan.parse_tables(page, mode)), mode)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
