"""Answers and triples as texts, good and bad, and scratch tables that go."""

from __future__ import annotations

import http.server
import json
import os
import re
import threading
import time

import pytest

from factloom import run
from factloom.operators import kb, mapping, rules
from factloom.plans.scratch import Scratch
from factloom.sources import answers, sinks
from factloom.sources.http import fetch_pages
from factloom.sources.triples import read_triples
from factloom.streaming.extract import start_extraction
from tests.test_engine import PAGE, ROWS, RULES, TABLE, frame, values

SHAPE = "s string, p string, o string, o_kind string, datatype string"


def asked(spark, *bodies):
    return spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "id int, body string")


def test_answers_of_every_kind(spark):
    term = lambda v, **x: {"type": "uri", "value": v, **x}
    select = {"head": {"vars": ["res"]}, "results": {"bindings": [{"res": term("http://k/a")}, {"res": term("é", **{"xml:lang": "fr", "type": "literal"}), "other": term("x")}]}}
    count = {"results": {"bindings": [{"res_num": {"type": "literal", "datatype": "d", "value": "42"}}]}}
    pages = {"result": [{"rows": [1, {"a": [2]}]}, "text", None]}
    df = asked(spark, select, count, {"boolean": True}, {"boolean": False}, pages, {"message": "Error"}, json.dumps(select)[:-9], "Error 500", None, " ", "<html>", "[1]", {"results": {"bindings": []}}, {"result": []}, {"result": [], "message": "late"})
    status = ["OK"] * 5 + ["ERROR", "MALFORMED", "ERROR", "MISSING", "MISSING", "MALFORMED", "MALFORMED", "OK", "OK", "ERROR"]
    assert [r.status for r in answers.parsed(df).orderBy("id").collect()] == status
    assert values(answers.bindings(df).where("id = 0"), "place", "variable", "value", "kind", "lang") == [(0, "res", "http://k/a", "uri", None), (1, "other", "x", "uri", None), (1, "res", "é", "literal", "fr")]
    assert [r.n for r in answers.counted(df).orderBy("id").collect()] == [None, 42] + [None] * 13
    assert [r.id for r in answers.confirmed(df).where("known").collect()] == [2]
    assert values(answers.structures(df).where("not lost"), "id", "n") == [(13, 0), (4, 3)]
    assert values(kb.resource_names(answers.of_variable(asked(spark, {"results": {"bindings": [{"res": term("http://k/resource/A_b")}]}}), "res")), "resource") == [("A_b",)]
    assert answers.bindings(df.limit(0)).count() == 0


def test_triples_written_and_read(spark, tmp_path):
    texts = ['a "b" \\ c', "line\none\ttwo\r", "é . end", " .", "tail .\n", "", "@en", "x^^y", "# no comment", "100%", " "]
    rows = [(f"http://k/s{i % 3}", "http://k/p", x, "literal", "http://k/d") for i, x in enumerate(texts)]
    rows += [("http://k/s", "http://k/q", "http://k/o.", "iri", None), ("http://k/s", "http://k/q", "plain", "literal", None)]
    df = spark.createDataFrame(rows, SHAPE)
    for form in ("ntriples", "turtle"):
        assert sinks.write_graph(df, f"{tmp_path}/{form}", form)
        found = read_triples(spark, f"{tmp_path}/{form}")
        assert found.where("error is not null").count() == 0
        assert values(found, "s", "p", "o", "o_kind", "datatype") == values(df, "s", "p", "o", "o_kind", "datatype")
    assert read_triples(spark, f"{tmp_path}/ntriples", ["http://k/q"]).count() == 2
    assert read_triples(spark, f"{tmp_path}/turtle", ["http://k/none"]).count() == 0


def test_turtle_with_prefixes(spark, tmp_path):
    (tmp_path / "t.ttl").write_text(
        """@prefix k: <http://k/> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
# a comment .
k:a a k:K ;
    k:p "one"@en , "two"^^xsd:string ;
    k:q 5 , 1.5 , true ;
    .
PREFIX z: <http://z/>
.
_:b1 z:v.w <http://k/x;y,z> .
k:a no:prefix k:c .
k:a k:p .
"a" k:p k:c .
k:a k:p "open .
k:last k:p "the end" ."""
    )
    found = read_triples(spark, str(tmp_path / "t.ttl"))
    xsd = "http://www.w3.org/2001/XMLSchema#"
    want = [
        ("http://k/a", kb.TYPE, "http://k/K", "iri", None, None),
        ("http://k/a", "http://k/p", "one", "literal", None, "en"),
        ("http://k/a", "http://k/p", "two", "literal", xsd + "string", None),
        ("http://k/a", "http://k/q", "1.5", "literal", xsd + "decimal", None),
        ("http://k/a", "http://k/q", "5", "literal", xsd + "integer", None),
        ("http://k/a", "http://k/q", "true", "literal", xsd + "boolean", None),
        ("http://k/last", "http://k/p", "the end", "literal", None, None),
        ("_:b1", "http://z/v.w", "http://k/x;y,z", "iri", None, None),
    ]
    names = ("s", "p", "o", "o_kind", "datatype", "lang")
    assert values(found.where("error is null"), *names) == sorted(want, key=str)
    assert found.where("error is not null and s is null").count() == 4
    assert kb.match_patterns(found, "PREFIX k: <http://k/> ?s a k:K ; k:q 5").count() == 1


def test_statements_over_the_edge_of_a_range(spark, tmp_path):
    """Files are cut every few bytes, within statements; each is read once."""
    rows = [(f"http://k/s{i}", "http://k/p", "word " * (i % 50) + str(i), "literal", None) for i in range(400)]
    sinks.write_graph(spark.createDataFrame(rows, SHAPE).coalesce(1), f"{tmp_path}/g", "turtle")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        found = read_triples(spark, f"{tmp_path}/g")
        assert found.rdd.getNumPartitions() > 20
        assert values(found, "s", "o") == sorted(((r[0], r[2]) for r in rows), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def local(path):
    return re.sub("^file:/*", "/", path)


@pytest.fixture
def left(monkeypatch):
    """The folders of scratch tables made from now on that are there."""
    roots, begin = [], Scratch.__init__

    def made(self, spark, label):
        begin(self, spark, label)
        roots.append(local(self.root))

    monkeypatch.setattr(Scratch, "__init__", made)
    return lambda: {x for x in roots if os.path.isdir(x)}


def test_streams_leave_no_scratch_tables(spark, tmp_path, left):
    """Three batches with a store: what each kept is gone, and the triples are those of one run."""
    store = spark.createDataFrame([("http://kb.example.org/resource/Ann", "p", "o")], "s string, p string, o string")
    own = spark.createDataFrame(RULES, rules.RULES)
    html = [TABLE.format("S", ROWS)] * 3
    for i, h in enumerate(html):
        spark.createDataFrame([(i, f"Page_{i}", h)], PAGE).coalesce(1).write.json(f"{tmp_path}/in{i}")
    pages = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in*/")
    seen = []
    query = start_extraction(pages, own, f"{tmp_path}/out", f"{tmp_path}/check", kb=store, each=lambda batch, n: seen.append(left()), prefer_link=True, drop_summaries=False)
    query.awaitTermination(120)
    assert len(seen) == 3 and seen == [set()] * 3 and not left()
    once = run.extract(frame(spark, *html), own, kb=store)
    names = ("s", "p", "o", "o_kind")
    assert values(spark.read.parquet(f"{tmp_path}/out"), *names) == values(once.triples, *names)
    once.close()
    assert not left()


def test_an_extraction_keeps_its_results_only(spark, left):
    found = run.extract(frame(spark, TABLE.format("S", ROWS)), spark.createDataFrame(RULES, rules.RULES))
    (own,) = left()
    assert sorted(x.split("-")[1] for x in os.listdir(own)) == ["graph", "report"]
    assert found.report.first()["graph_size"] == found.triples.count() == 5
    found.close()


def test_known_classes(spark):
    store = spark.createDataFrame([("A", "p", "o"), ("A", "q", "o"), ("B", "p", "o")], "s string, p string, o string")
    asked = spark.createDataFrame([("A", 1), ("C", 2), (None, 3)], "s string, x int")
    assert values(kb.known_classes(asked, store), "s", "x", "known") == [("A", 1, True), ("C", 2, False), (None, 3, False)]


def test_scratch_tables_close(spark, left):
    scratch = Scratch(spark, "closing")
    scratch.save(spark.range(3), "x")
    assert left() == {local(scratch.root)}
    scratch.close()
    assert not left()
    Scratch(spark, "never").close()


def test_programs_read_a_store_of_triples(spark, tmp_path):
    frame(spark, TABLE.format("S", ROWS), TABLE.format("S", ROWS)).write.parquet(f"{tmp_path}/pages")
    path = rules.write_rules(spark.createDataFrame(RULES, rules.RULES), f"{tmp_path}/rules", "1")
    names = mapping.Names()
    sinks.write_graph(spark.createDataFrame([(names.resource("en") + "Page_1", kb.TYPE, names.ontology + "Person", "iri", None)], SHAPE), f"{tmp_path}/kb")
    run.main(["extract", "--pages", f"{tmp_path}/pages", "--rules", path, "--kb", f"{tmp_path}/kb", "--kb-form", "triples", "--topic", "Person", "--out", f"{tmp_path}/out", "--log", f"{tmp_path}/logs"])
    (name,) = os.listdir(f"{tmp_path}/logs")
    assert name.endswith("_LOG_extract_en_Person.log") and "'row_triples': 2" in (tmp_path / "logs" / name).read_text()
    assert spark.read.json(f"{tmp_path}/out/report").first()["row_triples"] == 2


def test_rows_are_numbered_over_batches(spark, tmp_path):
    """Pages of one resource in several batches, and after a restart, give the graph of one batch; a batch may be run again."""
    own = spark.createDataFrame(RULES, rules.RULES)
    pages = [(0, "A", TABLE.format("S", ROWS)), (1, "B", TABLE.format("T", ROWS)), (2, "A", TABLE.format("S", ROWS * 2)), (3, "B", TABLE.format("S", ROWS)), (4, None, TABLE.format("S", ROWS)), (5, "A", "<p>"), (6, "A", TABLE.format("S", ROWS))]

    def go(new, whole):
        for page in new:
            spark.createDataFrame([page], PAGE).coalesce(1).write.json(f"{tmp_path}/in{page[0]}")
        stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in*/")
        start_extraction(stream, own, f"{tmp_path}/out", f"{tmp_path}/check", whole=whole).awaitTermination(200)

    go(pages[:4], 2)
    go(pages[4:], 2)
    once = run.extract(spark.createDataFrame(pages, PAGE), own)
    names = ("s", "p", "o", "o_kind")
    found = spark.read.parquet(*(f"{tmp_path}/out/batch={i}" for i in range(7)))
    assert values(found, *names) == values(once.triples, *names) and found.where("p like '%/member'").count() == 2 + 4 + 2 + 2 + 2
    assert values(spark.read.parquet(f"{tmp_path}/out/_rows/batch=4"), "resource", "rows") == [("A", 6), ("B", 2), ("page_4", 2)]
    once.close()


def test_hosts_are_asked_a_few_at_once(spark):
    now, most, asked = [0], [0], []
    lock = threading.Lock()

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
                asked.append(self.path)
            time.sleep(0.02)
            self.send_response(404 if "bad" in self.path else 200)
            with lock:
                now[0] -= 1
            self.end_headers()
            self.wfile.write(b"<p>")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/"
    names = spark.createDataFrame([(i, f"bad{i}" if i % 10 == 0 else f"good{i}") for i in range(60)], "resource_ord long, resource string").repartition(4)
    scratch = Scratch(spark, "fetched")
    first = scratch.save(fetch_pages(names, base, tries=2, pause=0.0, at_once=2, interval=0.001), "pages")
    assert first.where("html is not null").count() == 54 and most[0] <= 2
    assert values(first.where("html is null").groupBy("tries").count(), "tries", "count") == [(2, 6)]
    asked.clear()
    more = names.unionByName(spark.createDataFrame([(100, "good100")], names.schema))
    again = scratch.save(fetch_pages(more, base, tries=3, pause=0.0, at_once=2, earlier=first), "pages")
    assert len(asked) == 6 + 1 and again.count() == 61
    assert values(again.groupBy("tries").count(), "tries", "count") == [(1, 55), (3, 6)]
    assert most[0] <= 2
    server.shutdown()
    scratch.close()
