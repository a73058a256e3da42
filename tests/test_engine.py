"""Operators on small frames: edge cases that the queries don't show."""

from __future__ import annotations

import http.server
import random
import re
import threading
import unicodedata
from unittest.mock import Mock

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as fn
from factloom.operators import explore, kb, mapping, report, rules, stats
from factloom.operators.refine import refine
from factloom.operators.rows import table_rows
from factloom.plans import skew
from factloom.plans.scratch import Scratch, shared_folder
from factloom.plans.skew import salted_join, sized
from factloom.sources import pages as scan
from factloom.sources import sinks
from factloom.sources.http import PagesSource, fetch, fetch_pages
from factloom.streaming.extract import start_extraction, stream_tables

PAGE = "page_id long, resource string, html string"
TABLE = '<h2><span id="s">{}</span></h2><table class="wikitable"><tr><th>Name</th><th>Age</th></tr>{}</table>'
ROWS = "<tr><td>Ann</td><td>20</td></tr><tr><td>Bob</td><td>-</td></tr>"
RULES = [("en", "section", "S", None, "SECTION_S", "member"), ("en", "loose", None, "Name", "Name", "name"), ("en", "loose", None, "Age", "Age", "age")]


def frame(spark, *html):
    return spark.createDataFrame([(i, f"Page_{i}", h) for i, h in enumerate(html)], PAGE)


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_rows_are_numbered_over_mapped_tables(spark):
    html = TABLE.format("S", ROWS) + TABLE.format("T", ROWS) + TABLE.format("S", ROWS + ROWS)
    rows = table_rows(refine(scan.parse_tables(frame(spark, html))))
    own = spark.createDataFrame(RULES, rules.RULES)
    found = mapping.make_triples(rows, own).where("kind = 'row'")
    assert values(found, "o") == [(f"http://kb.example.org/resource/Page_0__{i}",) for i in range(1, 7)]
    cells = mapping.make_triples(rows, own, "en").where("kind = 'cell'")
    assert cells.count() == 6 + 3  # empty cells give none


def test_other_chapters_have_their_host(spark):
    rows = table_rows(refine(scan.parse_tables(frame(spark, TABLE.format("S", ROWS)))))
    own = spark.createDataFrame([("it", *r[1:]) for r in RULES] + [("en", "loose", None, "Age", "Age", "years")], rules.RULES)
    assert all(s.startswith("http://it.kb.example.org/resource/") for (s,) in values(mapping.make_triples(rows, own, "it"), "s"))
    few = own.where("chapter = 'en' or kind <> 'loose'")
    assert values(mapping.make_triples(rows, few, "it", fallback="en").where("kind = 'cell'"), "p") == [("http://kb.example.org/ontology/years",)]


def test_status_of_tables(spark):
    bad = '<table class="wikitable"><tr><th>A</th><th>B</th></tr><tr><th>C</th></tr><tr><td>1</td></tr></table>'
    html = ('<table class="wikitable"><tr><td>1</td></tr></table>', bad, TABLE.format("S", ""), TABLE.format("S", ROWS), None, "", "<p>none</p>")
    assert values(refine(scan.parse_tables(frame(spark, *html))), "page_id", "status") == [(0, "E2"), (1, "E3"), (2, "E3"), (3, "OK")]


def test_tags_in_upper_case(spark):
    html = TABLE.format("S", ROWS)
    upper = re.sub(r"</?[a-z0-9]+", lambda m: m[0].upper(), html)
    assert "<TABLE" in upper
    found = [[r.asDict() | {"page_id": 0} for r in scan.parse_tables(frame(spark, x)).collect()] for x in (html, upper)]
    assert found[0] and found[0] == found[1]


def test_no_pages(spark):
    rows = table_rows(refine(scan.parse_tables(frame(spark, None))))
    own = spark.createDataFrame(RULES, rules.RULES)
    triples = mapping.make_triples(rows, own)
    assert triples.count() == 0
    row = report.full_report(frame(spark, None), refine(scan.parse_tables(frame(spark, None))), rows, own, triples).first()
    assert (row["resources_analysed"], row["tables_found"], row["cells_to_map"], row["effectiveness"]) == (1, 0, 0, 0.0)


def test_unmapped_keys_count_once_a_table(spark):
    html = TABLE.format("S", ROWS) + TABLE.format("T", ROWS)
    rows = table_rows(refine(scan.parse_tables(frame(spark, html))))
    own = spark.createDataFrame(RULES[:2], rules.RULES)
    assert report.unmapped(rows, own, "en").first()[:] == (1, 2 + 1)


def test_links_may_be_preferred(spark):
    html = TABLE.format("S", '<tr><td><a title="Ann Lee">Ann</a></td><td>1</td></tr>')
    rows = table_rows(refine(scan.parse_tables(frame(spark, html))))
    own = spark.createDataFrame(RULES, rules.RULES)
    given = lambda **x: values(mapping.make_triples(rows, own, **x).where("p like '%/name'"), "o")
    assert given() == [("Ann",)] and given(prefer_link=True) == [("Ann_Lee",)]


def test_entities_by_equality(spark):
    html = TABLE.format("S", "<tr><td> Roma Sud </td><td>1</td></tr><tr><td>Città</td><td>2</td></tr><tr><td>Roma</td><td>3</td></tr>")
    rows = table_rows(refine(scan.parse_tables(frame(spark, html))))
    base = "http://kb.example.org/resource/"
    known = spark.createDataFrame([(base + "Roma_Sud", "p", "o"), (base + "Citta", "p", "o")], "s string, p string, o string")
    found = mapping.make_triples(rows, spark.createDataFrame(RULES, rules.RULES), kb=known).where("p like '%/name'")
    assert values(found, "o", "o_kind") == [("Roma", "literal"), (base + "Città", "iri"), (base + "Roma_Sud", "iri")]


def test_rules_are_versions(spark, tmp_path):
    own = spark.createDataFrame(RULES, rules.RULES)
    path = rules.write_rules(own, str(tmp_path), "1")
    assert values(rules.read_rules(spark, path), "key") == values(own, "key")
    with pytest.raises(Exception, match="(?i)exist"):
        rules.write_rules(own, str(tmp_path), "1")
    template = spark.createDataFrame([("S", "sectionProperty", ""), ("S_tte_T_x", "H", "a-b c"), ("S", "", "z")], "section string, header string, property string")
    updated = rules.update_rules(own, template, "en")
    assert values(updated, "key", "property") == [("Age", "age"), ("Name", "name"), ("S_H", "abc"), ("T x_H", "abc")]
    assert ("loose", "H", "abc") in values(rules.parse_rules(template, "en", 2), "kind", "key", "property")


def test_patterns(spark):
    t = spark.createDataFrame([("a", "p", "b"), ("b", "q", "c"), ("a", kb.TYPE, "K"), ("x", "p", "x")], "s string, p string, o string")
    assert values(kb.match_patterns(t, "{?x <p> ?y . ?y <q> ?z}"), "x", "y", "z") == [("a", "b", "c")]
    assert values(kb.match_patterns(t, "?x <p> ?x"), "x") == [("x",)]
    assert values(kb.match_patterns(t, '?x a <K>. ?x <p> "b"'), "x") == [("a",)]
    for bad in ("?x <p>", "", "?x <p> ?y . ?a <p> ?b", "?x p ?y"):
        with pytest.raises(ValueError):
            kb.match_patterns(t, bad)
    assert kb.class_exists(t, "a") and not kb.class_exists(t, "K")
    assert values(kb.topic_subjects(t, "?s <q> ?z", ""), "s") == [("b",)]


def test_patterns_in_full(spark):
    t = spark.createDataFrame(
        [("http://k/a", kb.TYPE, "http://k/K", None), ("http://k/a", "http://k/p", "one", "en"), ("http://k/a", "http://k/p", "uno", "it"), ("http://k/a", "http://k/q", "5", None), ("http://k/b", kb.TYPE, "http://k/K", None), ("http://k/b", "http://k/q", "7", None), ("http://k/b", kb.LABEL, "bee", "en")],
        "s string, p string, o string, lang string",
    )
    head = "PREFIX k: <http://k/> PREFIX : <http://k/> "
    found = lambda where, *names: values(kb.match_patterns(t, head + where), *names)
    assert found("?s a k:K ; k:q ?q", "s", "q") == [("http://k/a", "5"), ("http://k/b", "7")]
    assert found('?s k:p "uno", "one" ; a :K .', "s") == [("http://k/a",)]
    assert found('?s k:p "one"@en', "s") == [("http://k/a",)] and found('?s k:p "one"@it', "s") == []
    assert found("{ ?s a k:K . ?s k:q ?q OPTIONAL { ?s k:p ?x . FILTER(?q > 0) } }", "s", "x") == [("http://k/a", "one"), ("http://k/a", "uno"), ("http://k/b", None)]
    # an option's filter sees what stands before the option, and not what comes after it
    assert found("{ ?s a k:K OPTIONAL { ?s k:p ?x . FILTER(?q > 0) } . ?s k:q ?q }", "s", "x") == [("http://k/a", None), ("http://k/b", None)]
    assert found("?s a k:K . { ?s k:p ?x } UNION { ?s rdfs:label ?x }", "s", "x") == [("http://k/a", "one"), ("http://k/a", "uno"), ("http://k/b", "bee")]
    assert found("?s k:q 7 ; a ?c FILTER(?c = <http://k/K>)", "s", "c") == [("http://k/b", "http://k/K")]
    for bad in ("?s no:p ?o", "?s a", "?s a k:K OPTIONAL { ?x k:q ?y }", "OPTIONAL { ?s a k:K }", "{ ?s a k:K", "?s a k:K ?p", "?s a k:K FILTER(?z > 1)", "{ ?s a k:K } UNION ?x"):
        with pytest.raises(ValueError):
            kb.match_patterns(t, head + bad)


def test_groups_of_sections_by_the_plain_fold(spark):
    """Grouping over components, and its index, against the fold over all names in order."""

    def plain(sections):
        groups: list[list[str]] = []
        for section in dict.fromkeys(sections):
            low = section.lower()
            near = next((g for g in groups if any(low in m.lower() for m in g) or len(g) == 1 and g[0].lower() in low), None)
            if near is not None:
                groups.remove(near)
            groups.append([*(near or []), section])
        return {s: "_tte_".join(g) for g in groups for s in g}

    rng = random.Random(5)
    for size in (3, 20, 60):
        names = list(dict.fromkeys("".join(rng.choice("abcA ") for _ in range(rng.randrange(1, 9))) for _ in range(size)))
        for own in (names, [*names, ""], ["", *names]):
            assert explore.group_similar(own) == plain(own)
    names = list(dict.fromkeys("".join(rng.choice("abcdeA ") for _ in range(rng.randrange(1, 9))) for _ in range(150)))
    for own in (names, [*names[:70], "", *names[70:]]):
        refined = spark.createDataFrame([(i, f"P{i}", 0, s, 3, "OK") for i, s in enumerate(own)], "page_id long, resource string, table_ord int, section string, n_rows int, status string")
        assert {r["section"]: r["group"] for r in explore.section_vocabulary(refined, True).collect()} == plain(own)
    assert explore.section_vocabulary(refined.limit(0), True).count() == 0


def test_running_totals(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL", 0)
    rng = random.Random(2)
    ids = [rng.randrange(300) if i % 2 else 7 for i in range(2000)] + [10**15]
    rows = [(i, rng.randrange(5)) for i in ids]
    df = spark.createDataFrame([*rows, (None, 3)], "page_id long, n long")
    got = stats.running_total(df, 40).collect()
    assert len(got) == 2002
    for r in got:
        assert r["total"] == (None if r["page_id"] is None else sum(n for i, n in rows if i <= r["page_id"]))
    once = spark.createDataFrame([(i, 2) for i in range(1000)], "page_id long, n long")
    assert all(r["total"] == 2 * (r["page_id"] + 1) for r in stats.running_total(once, 30).collect())


def test_entities_of_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL", 0)
    html = TABLE.format("S", "<tr><td>Yes</td><td>1</td></tr>" * 700 + "<tr><td>No</td><td>1</td></tr>" * 30)
    rows = table_rows(refine(scan.parse_tables(frame(spark, html))), drop_summaries=False)
    base = "http://kb.example.org/resource/"
    known = spark.createDataFrame([(base + "Yes", "p", "o")] * 3, "s string, p string, o string")
    found = mapping.make_triples(rows, spark.createDataFrame(RULES, rules.RULES), kb=known).where("p like '%/name'")
    assert values(found.groupBy("o", "o_kind").count(), "o", "o_kind", "count") == [("No", "literal", 30), (base + "Yes", "iri", 700)]


def test_pages_without_a_name(spark):
    html = TABLE.format("S", ROWS)
    pages = spark.createDataFrame([(1, None, html), (2, None, html), (3, "A", html)], PAGE)
    rows = table_rows(refine(scan.parse_tables(pages)))
    found = mapping.make_triples(rows, spark.createDataFrame(RULES, rules.RULES)).where("kind = 'row'")
    base = "http://kb.example.org/resource/"
    assert values(found, "o") == sorted((f"{base}{x}__{i}",) for x in ("page_1", "page_2", "A") for i in (1, 2))


def test_blocks_of_many_objects(spark):
    shape = "s string, p string, o string, o_kind string, datatype string"
    t = spark.createDataFrame([("s", "p", f"o{i}", "iri", None) for i in range(250)] + [("t", "p", "x", "iri", None)], shape)
    blocks = [r["value"] for r in sinks.turtle_blocks(t, 100).collect()]
    assert 3 <= len(blocks) <= 4 and all(b.endswith(" .") for b in blocks)
    assert sorted(re.findall(r"<(o\d+)>", "".join(blocks))) == sorted(f"o{i}" for i in range(250))


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL", 0)
    many = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(900)] + [(None, i) for i in range(300)], "k long, x long")
    one = spark.createDataFrame([(1, "a"), (3, "b"), (4, "c"), (4, "d")], "k long, y string")
    for how in ("inner", "left"):
        got, expected = salted_join(many, one, "k", F.col("x"), 1200, how), many.join(one, "k", how)
        assert got.columns == expected.columns and values(got, "k", "x", "y") == values(expected, "k", "x", "y")
    assert salted_join(many.limit(0), one, "k", F.col("x"), 0).count() == 0
    few = Scratch(spark, "t").save(one.select("y"), "y")
    assert sized(few) is not few


def test_lookups_in_few_and_in_many_rules(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("Name").alias("k"), "id")
    one = spark.createDataFrame([("Name", "p"), ("3", None), ("6", "q"), ("-", "r")], "k string, v string")
    expected = sorted(many.join(one, "k", "left").collect(), key=str)
    few, dealt = (skew.lookup(many, one, "k", F.col("id"), few_bytes=n, parts=5) for n in (skew.FEW_BYTES, -1))
    for found in few, dealt:
        assert found.columns == ["k", "id", "v"]
        assert sorted(found.collect(), key=str) == expected
    assert "_piece" not in few._jdf.queryExecution().toString()
    assert "_piece" in dealt._jdf.queryExecution().toString()
    assert skew.lookup(many, one.limit(0), "k", F.col("id")).where("v is not null").isEmpty()


def test_properties_by_many_rules(spark):
    """Strict before loose, an empty strict rule too, whether the rules are broadcast or dealt."""
    own = spark.createDataFrame([("strict", "S_A", ""), ("any", "A", "a"), ("loose", "B", "b"), ("any", "S_C", "c")], "kind string, key string, property string")
    cells = spark.createDataFrame([("S", h, i) for i in range(40) for h in ("A", "B", "C", "D")] + [("T", "A", 0), (None, "B", 0)], "section string, header string, at int")
    plain = {("S", "A"): "", ("S", "B"): "b", ("S", "C"): "c", ("S", "D"): None, ("T", "A"): "a", (None, "B"): "b"}
    for few in (skew.FEW_BYTES, -1):
        found = mapping.with_property(cells, own, F.col("at"), few).collect()
        assert len(found) == cells.count()
        assert all(r.property == plain[r.section, r.header] for r in found)


def test_no_local_folder_on_a_cluster():
    session = Mock()
    session.conf.get.return_value = None
    session.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    for master in ("spark://somewhere:7077", "yarn", "local-cluster[2,1,1024]"):
        session.sparkContext.master = master
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(session)
    session.sparkContext.master = "local[4]"
    assert shared_folder(session).startswith("file://")
    session.conf.get.return_value = "hdfs://x/y/"
    assert shared_folder(session) == "hdfs://x/y"


def test_similar_sections():
    assert explore.group_similar(["College", "College statistics", "Coach", "college"]) == {"College": "College_tte_College statistics_tte_college", "College statistics": "College_tte_College statistics_tte_college", "Coach": "Coach", "college": "College_tte_College statistics_tte_college"}
    assert explore.group_similar(["A", ""]) == {"A": "A_tte_", "": "A_tte_"}


def test_arguments():
    explore.check_arguments("en", 1, topic="Actor")
    for bad in (("xx", 1, None, "A"), ("en", 3, None, "A"), ("en", 1, None, "A1"), ("en", 1, "x", "A"), ("en", 1)):
        with pytest.raises(ValueError):
            explore.check_arguments(*bad)


def test_functions(spark):
    texts = [("20",), (" 1e5 ",), ("1,000",), ("1.0f",), ("0x1p3",), ("NaN",), ("",), (None,), ("-.5",), ("5D",)]
    df = spark.createDataFrame(texts, "x string")
    assert [r[0] for r in df.select(fn.is_float(F.col("x"))).collect()] == [True, True, False, False, False, True, False, False, True, False]
    df = spark.createDataFrame([("Città [1]?", "a b*~", "http://x/resource/AC/DC", "http://x")], "a string, b string, c string, d string")
    got = df.select(fn.ascii_dots(fn.strip_citations(F.col("a"))), fn.query_plus(F.col("b")), fn.segment_after(F.col("c")), fn.segment_after(F.col("d")), fn.last_segment(F.col("c")), fn.plain_accents(F.col("a"))).first()
    assert got[:] == ("Citt. .", "a+b%2A%7E", "AC", None, "DC", "Citta [1]?")


def test_accents_as_the_standard_has_them(spark):
    chars = [chr(i) for i in range(0x20, 0x3000) if not 0xD800 <= i < 0xE000] + ["\U0001d400", "e\u0301x", "\uff21"]
    df = spark.createDataFrame([(c,) for c in chars], "x string")
    got = {r[0]: r[1] for r in df.select("x", fn.plain_accents(F.col("x"))).collect()}
    assert all(got[c] == unicodedata.normalize("NFD", c).encode("ascii", "ignore").decode() for c in chars)
    assert not any(unicodedata.normalize("NFD", chr(i)).encode("ascii", "ignore") for i in range(0x10000, 0x110000))


def test_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, html string")
    assert stats.running_total(stats.count_structures(empty, "list")).count() == 0
    lost = spark.createDataFrame([(1, None), (2, "Error 500"), (3, "<table><li>")], "page_id long, html string")
    assert values(stats.count_structures(lost, "table"), "page_id", "n", "lost") == [(1, 0, True), (2, 0, True), (3, 1, False)]


def test_sinks(spark, tmp_path):
    shape = "s string, p string, o string, o_kind string, datatype string"
    t = spark.createDataFrame([("s", "p", 'a"\n\\', "literal", "d"), ("s", "p", "x y", "iri", None)], shape)
    assert values(sinks.ntriples_lines(t), "value") == [('<s> <p> "a\\"\\n\\\\"^^<d> .',), ("<s> <p> <x_y> .",)]
    assert sinks.write_graph(t, f"{tmp_path}/g") and not sinks.write_graph(t.limit(0), f"{tmp_path}/h")
    assert spark.read.text(f"{tmp_path}/g").count() == 2
    names = spark.createDataFrame([("a",), ("b",)], "resource string")
    sinks.write_resources(names, f"{tmp_path}/names")
    assert values(scan.read_resources(spark, f"{tmp_path}/names"), "resource") == [("a",), ("b",)]
    assert scan.one_resource(spark, "x").first()[:] == (0, "x")
    sinks.write_template(spark.createDataFrame([("S", "h", "p")], "section string, header string, property string"), f"{tmp_path}/t", topic="T")
    assert spark.read.json(f"{tmp_path}/t").first()["topic"] == "T"


def test_pages_over_http(spark):
    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(200 if "good" in self.path else 404)
            self.end_headers()
            self.wfile.write(b"<p>" + self.path.encode() + b"</p>")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/"
    spark.dataSource.register(PagesSource)
    df = spark.read.format("factloom_pages").option("base", base).option("names", "good a\nbad").option("pause", "0").load()
    assert values(df, "resource", "html") == [("bad", None), ("good a", "<p>/good%20a</p>")]
    assert fetch(base + "bad", pause=0) is None
    names = spark.createDataFrame([(i, f"good {i}" if i % 3 else "bad") for i in range(120)] + [(500, None)], "resource_ord long, resource string")
    got = fetch_pages(names, base, tries=2, pause=0.0, batch=7)
    assert got.where("html is null").count() == 41 and got.where("resource like 'good%' and html = concat('<p>/', replace(resource, ' ', '%20'), '</p>')").count() == 80
    assert values(got.groupBy("tries").count(), "tries", "count") == [(0, 1), (1, 80), (2, 40)]
    assert values(stats.lost_pages(got), "reason", "n", "calls") == [("missing", 41, 80)]
    assert fetch_pages(names.limit(0), base).count() == 0
    server.shutdown()


def test_stream(spark, tmp_path):
    frame(spark, TABLE.format("S", ROWS)).write.json(f"{tmp_path}/in")
    pages = spark.readStream.schema(PAGE).json(f"{tmp_path}/in")
    assert stream_tables(pages).isStreaming
    own = spark.createDataFrame(RULES, rules.RULES)
    start_extraction(pages, own, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2 + 3
