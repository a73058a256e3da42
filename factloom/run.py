"""The three programs: extract triples, explore a vocabulary, count structures.

    python -m factloom.run extract  --pages P --rules R --out O [--kb K] [--chapter en] ...
    python -m factloom.run explore  --pages P --rules R --out O [--kb K] [--format 1|2] ...
    python -m factloom.run stats    --pages P [--kb K --where PATTERN]
    python -m factloom.run update   --rules R --template T --out FOLDER --version V

Pages are Parquet (page_id, resource, html); rules and templates JSON; a store of
triples is Parquet (s, p, o, lang), or N-Triples or Turtle with --kb-form triples. Pages are chosen by --single NAME, --topic
CLASS or --where PATTERN over the store, --list FILE of names, or all are taken.
--log FOLDER adds what is reported to a file there, on the driver.
--run NAME adds the graph and the report to those of other runs, each whole or not
at all; a run that is there already is not written again.
--check refuses a class that the store doesn't know; --fallback names the chapter
whose rules hold where the own one has none. ``update`` takes the chapter and
the format of a template from what ``explore`` wrote with it.
"""

from __future__ import annotations

import argparse
import datetime
import logging
import os
import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import explore as vocabulary
from factloom.operators import kb as store
from factloom.operators import stats
from factloom.operators.mapping import Names, chapter_rules, graph, make_triples
from factloom.operators.refine import refine
from factloom.operators.report import full_report
from factloom.operators.rows import table_rows
from factloom.operators.rules import check_ontology, parse_rules, read_rules, upsert_rules, write_rules
from factloom.plans.scratch import Scratch
from factloom.sources import sinks
from factloom.sources.pages import dealt, parse_tables, read_resources, with_status
from factloom.sources.triples import read_triples

log = logging.getLogger("factloom")


class Extraction(NamedTuple):
    """The graph and its report, tables of a scratch folder until ``close``, or the program's end."""

    triples: DataFrame
    report: DataFrame
    scratch: Scratch

    def close(self) -> None:
        """Delete both, when they are written elsewhere."""
        self.scratch.close()


def extract(pages: DataFrame, rules: DataFrame, chapter: str = "en", kb: DataFrame | None = None, names: Names = Names(), mode: str = "compat", drop_summaries: bool = True, fallback: str | None = None, prefer_link: bool = False) -> Extraction:
    """The graph of the pages' tables, and the metrics of its extraction. Parsing runs once, and only the results stay."""
    scratch = Scratch(pages.sparkSession, "extract")
    good = with_status(pages).where("status = 'OK'").drop("status")
    refined = scratch.save(refine(parse_tables(dealt(good), mode)), "tables")
    rows = scratch.save(table_rows(refined, mode, drop_summaries), "rows")
    triples = scratch.save(make_triples(rows, rules, chapter, kb, names, fallback, prefer_link, scratch), "triples")
    found = scratch.save(graph(triples), "graph")
    report = scratch.save(full_report(good, refined, rows, rules, triples, chapter, fallback, found), "report")
    scratch.clear(found, report)
    return Extraction(found, report, scratch)


def explore(pages: DataFrame, rules: DataFrame, chapter: str = "en", kb: DataFrame | None = None, output_format: int = 1, similar: bool = False, mode: str = "compat") -> DataFrame:
    """The template of the pages' sections and headers. No data cell is read."""
    refined = Scratch(pages.sparkSession, "explore").save(refine(parse_tables(dealt(pages), mode, data=False)), "tables")
    own = chapter_rules(rules, chapter)
    sections = vocabulary.section_vocabulary(refined, similar)
    return vocabulary.template(sections, vocabulary.header_vocabulary(refined, sections, own, kb, chapter), own, output_format)


def choose(pages: DataFrame, kb: DataFrame | None = None, single: str | None = None, topic: str | None = None, where: str | None = None, names: Names = Names(), listed: DataFrame | None = None, check: bool = False) -> DataFrame:
    """The pages of one resource, of a list (resource), of a class, or of a pattern over the store.

    ``check``: raise ValueError for a class that is no subject of the store.
    """
    if single is not None:
        return pages.where(F.col("resource") == single)
    if listed is not None:
        return pages.join(listed.select("resource").distinct(), "resource", "left_semi").select(*pages.columns)
    if topic is None and where is None:
        return pages
    if kb is None:
        raise ValueError("a class or a pattern needs a store")
    if check and topic is not None and not store.class_exists(kb, names.ontology + topic):
        raise ValueError(f"the store has no class {topic}")
    subjects = store.of_class(kb, names.ontology + topic) if topic is not None else store.topic_subjects(kb, where, names.ontology)
    return pages.join(store.resource_names(subjects), "resource", "left_semi").select(*pages.columns)


def log_to(folder: str, program: str, chapter: str, topic: str) -> str:
    """Log to a new file of the driver from now on, in place of the one before, named by the time, the program, the chapter and the topic. Returns its path."""
    for old in [h for h in log.handlers if isinstance(h, logging.FileHandler)]:
        log.removeHandler(old)
        old.close()
    named = "_".join([f"{datetime.datetime.now():%Y_%m_%d-%H_%M}", "LOG", program, chapter, re.sub(r"\W+", "_", topic)[:40]]).rstrip("_")
    os.makedirs(folder, exist_ok=True)
    handler = logging.FileHandler(os.path.join(folder, f"{named}.log"), encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.addHandler(handler)
    return handler.baseFilename


def main(args: list[str] | None = None) -> None:
    given = argparse.ArgumentParser(prog="factloom")
    given.add_argument("program", choices=("extract", "explore", "stats", "update"))
    for name in ("pages", "rules", "template", "kb", "out", "version", "single", "topic", "where", "list", "chapter", "fallback", "log", "run"):
        given.add_argument(f"--{name}")
    given.add_argument("--format", type=int)
    given.add_argument("--host", default=Names.host)
    given.add_argument("--mode", choices=("compat", "clean"), default="compat")
    given.add_argument("--kb-form", choices=("parquet", "triples"), default="parquet")
    for name in ("similar", "turtle", "check", "keep-summaries", "prefer-link"):
        given.add_argument(f"--{name}", action="store_true")
    x = given.parse_args(args)
    names = Names(x.host)
    if x.single or x.topic or x.where or x.chapter:
        vocabulary.check_arguments(x.chapter or "en", x.format or 1, x.single, x.topic, x.where, one=bool(x.single or x.topic or x.where))
    if x.log:
        log_to(x.log, x.program, x.chapter or "en", x.topic or x.single or x.where or "")
    spark = SparkSession.builder.getOrCreate()
    kb = (read_triples(spark, x.kb).where("error is null") if x.kb_form == "triples" else spark.read.parquet(x.kb)) if x.kb else None
    if x.program == "update":
        template, made_for = sinks.read_template(spark, x.template)
        new = parse_rules(template, x.chapter or made_for.get("chapter", "en"), x.format or int(made_for.get("format", 1)))
        good, bad = check_ontology(new, kb) if kb is not None else (new, None)
        if bad is not None and not bad.isEmpty():
            sinks.write_report(bad, f"{x.out}/rejected={x.version}")
            log.warning("%d rules name no property of the store: %s/rejected=%s", bad.count(), x.out, x.version)
        write_rules(upsert_rules(read_rules(spark, x.rules), good), x.out, x.version)
        return
    listed = read_resources(spark, x.list) if x.list else None
    pages = choose(spark.read.parquet(x.pages), kb, x.single, x.topic, x.where, names, listed, x.check)
    chapter = x.chapter or "en"
    if x.program == "stats":
        total = stats.totals(pages)
        log.warning("%s", total.first().asDict())
        total.show(truncate=False)
        stats.lost_pages(pages).orderBy(F.desc("n"), "reason").show(truncate=False)
    elif x.program == "explore":
        form = x.format or 1
        found = explore(pages, read_rules(spark, x.rules), chapter, kb, form, x.similar, x.mode)
        sinks.write_template(found, x.out, chapter=chapter, topic=x.topic or x.single or x.where or "", format=str(form))
    else:
        found = extract(pages, read_rules(spark, x.rules), chapter, kb, names, x.mode, not x.keep_summaries, x.fallback, x.prefer_link)
        sinks.write_graph(found.triples, f"{x.out}/graph", "turtle" if x.turtle else "ntriples", x.run)
        sinks.write_report(found.report, f"{x.out}/report", x.run)
        log.warning("%s", found.report.first().asDict())
        found.close()


if __name__ == "__main__":
    logging.basicConfig(format="%(asctime)s %(message)s")
    main()
