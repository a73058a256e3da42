"""The programs end to end, over written tables."""

from __future__ import annotations

import re

import pytest

from factloom import run
from factloom.operators import rules
from factloom.operators.kb import TYPE
from factloom.sources.http import compose
from tests.test_engine import RULES, ROWS, TABLE, frame


def test_programs(spark, tmp_path):
    given = lambda name: f"{tmp_path}/{name}"
    frame(spark, TABLE.format("S", ROWS), TABLE.format("S", ROWS), None).write.parquet(given("pages"))
    own = rules.rules_from_dict(spark, {"SECTION_S": "member", "S_Name": "name", "Age": "age"}, "en")
    path = rules.write_rules(own, given("rules"), "1")
    names = run.Names()
    spark.createDataFrame([(names.resource("en") + "Page_1", TYPE, names.ontology + "Person", None)], "s string, p string, o string, lang string").write.parquet(given("kb"))
    run.main(["extract", "--pages", given("pages"), "--rules", path, "--out", given("out")])
    assert spark.read.text(given("out/graph")).count() == 2 * (2 + 3)
    assert spark.read.json(given("out/report")).first()["effectiveness"] == 1.0
    run.main(["extract", "--pages", given("pages"), "--rules", path, "--kb", given("kb"), "--topic", "Person", "--out", given("few"), "--turtle"])
    assert spark.read.json(given("few/report")).first()["row_triples"] == 2
    run.main(["explore", "--pages", given("pages"), "--rules", path, "--single", "Page_0", "--format", "2", "--out", given("template")])
    assert {(r["header"], r["property"]) for r in spark.read.json(given("template")).collect()} == {("sectionProperty", "member"), ("Name", "name"), ("Age", "age")}
    run.main(["update", "--rules", path, "--template", given("template"), "--out", given("rules"), "--version", "2"])
    assert spark.read.json(given("rules/version=2")).count() == 5
    run.main(["stats", "--pages", given("pages")])
    with pytest.raises(ValueError):
        run.main(["explore", "--pages", given("pages"), "--chapter", "xx", "--single", "a"])
    with pytest.raises(ValueError):
        run.choose(frame(spark, ""), None, where="?s a <x>")


def test_one_kind_of_rule_serves_both(spark):
    assert [r["kind"] for r in rules.rules_from_dict(spark, {"SECTION_S": "a", "S_H": "b", "H": "c"}, "it").collect()] == ["section", "any", "any"]
    assert spark.createDataFrame(RULES, rules.RULES).count() == 3


def test_addresses():
    assert compose("http://x/sparql", query="a b*~", format="json") == "http://x/sparql?query=a+b%2A%7E&format=json"
    assert compose("http://x") == "http://x"


def test_choices_and_options(spark, tmp_path):
    given = lambda name: f"{tmp_path}/{name}"
    sums = "<tr><td>Ann</td><td>20</td></tr><tr><td>Bob</td><td>30</td></tr><tr><td>All of these people</td><td>50</td></tr>"
    table = TABLE.replace("<th>Age</th>", "<th>Age</th><th>More</th>")
    rows = re.sub(r"<td>(\d+)</td>", r"<td>\1</td><td>\1</td>", sums).replace("<td>Ann</td>", '<td><a title="Ann Lee">Ann</a></td>')
    frame(spark, table.format("S", rows), TABLE.format("S", ROWS), TABLE.format("S", ROWS)).write.parquet(given("pages"))
    own = rules.rules_from_dict(spark, {"SECTION_S": "member", "Name": "name"}, "it").unionByName(rules.rules_from_dict(spark, {"Name": "no", "Age": "age"}, "en"))
    path = rules.write_rules(own, given("rules"), "1")
    (tmp_path / "names").write_text("Page_0\nPage_2\n\n")
    report = lambda name: spark.read.json(given(f"{name}/report")).first()
    common = ["extract", "--pages", given("pages"), "--rules", path]
    run.main([*common, "--list", given("names"), "--chapter", "it", "--out", given("a")])
    assert (report("a")["row_triples"], report("a")["cell_triples"]) == (4, 4)
    run.main([*common, "--list", given("names"), "--chapter", "it", "--fallback", "en", "--keep-summaries", "--prefer-link", "--out", given("b")])
    assert (report("b")["row_triples"], report("b")["cell_triples"]) == (5, 5 + 4)
    assert any("Ann_Lee" in r[0] for r in spark.read.text(given("b/graph")).collect())
    spark.createDataFrame([("http://kb.example.org/resource/Page_1", TYPE, "http://kb.example.org/ontology/Person", None), ("http://kb.example.org/ontology/age", TYPE, "http://www.w3.org/2002/07/owl#DatatypeProperty", None)], "s string, p string, o string, lang string").write.parquet(given("kb"))
    with pytest.raises(ValueError, match="no class Person"):
        run.main([*common, "--kb", given("kb"), "--topic", "Person", "--check", "--out", given("c")])
    run.main(["explore", "--pages", given("pages"), "--rules", path, "--chapter", "it", "--format", "2", "--out", given("template")])
    run.main(["update", "--rules", path, "--template", given("template"), "--out", given("rules"), "--version", "2"])
    assert {(r["chapter"], r["kind"], r["key"]) for r in spark.read.json(given("rules/version=2")).collect()} >= {("it", "section", "SECTION_S"), ("it", "loose", "Name")}
    run.main(["update", "--rules", path, "--template", given("template"), "--kb", given("kb"), "--out", given("rules"), "--version", "3"])
    assert {r["property"] for r in spark.read.json(given("rules/rejected=3")).collect()} == {"member", "name"}
    run.main(["stats", "--pages", given("pages")])
