"""Work is spread over tasks, done once, and not sent through the driver."""

from pyspark.sql import functions as F

from factloom import queries
from factloom.functions.text import letter_distance
from factloom.operators import mapping
from factloom.operators.patterns import Term, _Solver
from factloom.operators.refine import refine
from factloom.operators.rows import table_rows
from factloom.plans.skew import spread
from factloom.sources.commit import commit_lines
from factloom.sources.pages import dealt, parse_tables
from factloom.sources.sinks import write_graph
from factloom.sources.triples import read_triples

SMALLEST = "/root/testdata/sf0.001"
HTML = '<table class="wikitable"><tr><th>A</th></tr><tr><td>1</td></tr></table>'


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_of_one_partition_are_parsed_by_many_tasks(spark):
    pages = spark.range(200).coalesce(1).select(F.col("id").alias("page_id"), F.lit("x").alias("resource"), F.lit(HTML).alias("html"))
    found = parse_tables(dealt(pages)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in found) == 200 and len(found) > 4


def test_few_rows_with_much_work_are_spread(spark):
    rows = spark.range(500).coalesce(1)
    assert spread(rows, "id").select(F.spark_partition_id()).distinct().count() > 4
    assert sorted(r.id for r in spread(rows, "id").collect()) == list(range(500))


def test_row_numbers_parses_once_and_broadcasts_no_items(spark):
    plan = plan_of(queries.QUERIES["row_numbers"](spark, SMALLEST))
    assert plan.count("MapInArrow") == 1


def test_tables_are_not_broadcast_to_the_rules(spark):
    plan = queries.QUERIES["row_numbers"](spark, SMALLEST)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan


def test_letters_of_a_text_are_found_once(spark):
    asked = spark.createDataFrame([("Abc", "abd"), ("", "xyz"), (None, "a")], "a string, b string").select(letter_distance(F.col("a"), F.col("b")).alias("n"))
    assert plan_of(asked).count("split(") <= 2
    assert [r.n for r in asked.collect()] == [2, 3, None]


def test_parts_of_a_pattern_are_counted_by_rows_and_values(spark):
    few = [(f"s{i}", "kind", "x") for i in range(3)] + [(f"s{i}", "part", f"p{j}") for i in range(3) for j in range(20)]
    solver = _Solver(spark.createDataFrame(few, "s string, p string, o string"))
    star = solver.star(Term("v0"), [(Term(value="kind"), Term(value="x")), (Term(value="part"), Term("v1"))])
    assert (star.rows, star.values["v0"]) == (60, 3)
    (way,) = solver.parts([("triple", Term("v1"), ("^", Term(value="part")), Term("v0"))])
    assert (way.rows, way.values) == (60, {"v1": 20, "v0": 3})


def test_a_repeated_run_makes_no_lines(spark, tmp_path):
    commit_lines(spark.createDataFrame([("a",)], "value string"), str(tmp_path), "one")
    commit_lines(spark.range(3).select(F.raise_error(F.lit("made again")).cast("string").alias("value")), str(tmp_path), "one")
    assert [r.value for r in spark.read.text(f"{tmp_path}/run=one").collect()] == ["a"]


def test_tables_and_rows_are_not_made_again_by_filters(spark):
    for name in ("clean_spans", "order_triples"):
        filters = [x.strip(" :") for x in plan_of(queries.QUERIES[name](spark, SMALLEST)).split("\n") if x.strip(" :").startswith("+- Filter")]
        assert filters and max(map(len, filters)) < 2000


def test_numbered_tables_are_dealt_in_more_parts_without_links(spark):
    plan = queries.QUERIES["order_triples"](spark, SMALLEST)._jdf.queryExecution().optimizedPlan()
    dealt_by = [x for x in plan.toString().split("\n") if "RepartitionByExpression [resource" in x]
    assert len(dealt_by) == 1 and int(dealt_by[0].rsplit(",", 1)[1]) >= 4 * 8
    rows = parse_tables(spark.createDataFrame([(1, "A", HTML.replace("<td>1", '<td><a title="T t">1</a>'))], "page_id long, resource string, html string"))
    found = mapping.mapped_rows(table_rows(refine(rows)), mapping.chapter_rules(queries.rule_frame(spark, ("section", "SECTION_A", "a")), "en"), "b/", links=True)
    (row,) = found.collect()
    assert [c.asDict() for c in row["cells"]] == [{"header": "A", "value": "1.0", "link": "T_t"}]
    assert "link" not in mapping.mapped_rows(table_rows(refine(rows)), mapping.chapter_rules(queries.rule_frame(spark, ("section", "SECTION_A", "a")), "en"), "b/").schema["cells"].dataType.elementType.names


def test_records_without_an_asked_address_are_not_taken_apart(spark, tmp_path):
    (tmp_path / "t.nt").write_text('# <k:a> PREFIX x\n<s:1> <k:a> "1" .\n<s:2> <k:b> "<k:a>" .\n<s:3> <k:c> "3. #" .\n')
    found = read_triples(spark, str(tmp_path / "t.nt"), ["k:a"])
    assert [(r.s, r.p, r.o, r.error) for r in found.collect()] == [("s:1", "k:a", "1", None)]
    assert "Contains(value" in plan_of(found) or "<k:a>)" in plan_of(found).split("Relation")[0].split("\n")[-1]


def test_a_closure_writes_each_pair_once(spark):
    chain = [(f"n{i:02d}", "next", f"n{i + 1:02d}") for i in range(12)]
    solver = _Solver(spark.createDataFrame(chain, "s string, p string, o string"))
    found = solver.pairs(("+", Term(value="next")), Term("a"), Term("b"))
    assert sorted((r.s, r.o) for r in found.collect()) == sorted((f"n{i:02d}", f"n{j:02d}") for i in range(13) for j in range(i + 1, 13))
    rounds = [p for p in solver.scratch.paths.values() if not p.endswith("step")]
    assert sum(spark.read.parquet(p).count() for p in rounds) == 78


def test_a_graph_is_made_once_to_be_written_as_turtle(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    graph = spark.createDataFrame([("s:1", "p:1", "a", "literal", None)], "s string, p string, o string, o_kind string, datatype string")
    assert write_graph(graph.mapInArrow(counted, graph.schema), str(tmp_path / "t"), "turtle")
    assert made.value == 1 and spark.read.text(str(tmp_path / "t")).first()[0] == '<s:1> <p:1> "a" .'
