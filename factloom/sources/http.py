"""Pages over HTTP: each name is one fetch in some task.

``fetch_pages`` takes names as a frame of any size; the data source takes a
short list as an option.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "page_id long, resource string, url string, html string"
TRIES, PAUSE, TIMEOUT = 3, 2.0, 30.0


def fetch(url: str, tries: int = TRIES, pause: float = PAUSE, timeout: float = TIMEOUT) -> str | None:
    """The body at ``url``; None when every try failed."""
    return fetch_counted(url, tries, pause, timeout)[0]


def fetch_counted(url: str, tries: int = TRIES, pause: float = PAUSE, timeout: float = TIMEOUT) -> tuple[str | None, int]:
    """The body at ``url``, None when every try failed, and the number of tries."""
    for i in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
                return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace"), i + 1
        except (urllib.error.URLError, TimeoutError, OSError):
            if i + 1 < tries:
                time.sleep(pause)
    return None, tries


def _lanes(names: DataFrame, at_once: int) -> DataFrame:
    """Names dealt so that those of one host are in so many partitions at most, each of which asks for one page after another."""
    host = F.coalesce(F.parse_url("base", F.lit("HOST")), F.lit(""))
    lane = F.pmod(F.xxhash64("resource_ord"), F.lit(at_once))
    parts = max(at_once, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return names.repartition(parts, host, lane)


def fetch_pages(
    names: DataFrame,
    base: str,
    tries: int = TRIES,
    pause: float = PAUSE,
    timeout: float = TIMEOUT,
    batch: int = 50,
    at_once: int | None = None,
    interval: float = 0.0,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """(page_id, resource, url, html, tries) of names (resource_ord, resource, optionally base): pages that come are passed on ``batch`` at a time.

    ``at_once``: requests to one host at the same time, at most (a task that runs again
    beside its first attempt asks besides); ``interval``: seconds between two requests of a task. ``earlier``: what a run
    before gave, as a table; pages that came then are not asked for again, and for
    others only the tries that are left are made.
    """
    asked = names.select(F.col("resource_ord").cast("long").alias("resource_ord"), "resource", (F.coalesce("base", F.lit(base)) if "base" in names.columns else F.lit(base)).alias("base"))
    before = F.lit(0)
    if earlier is not None:
        asked = asked.join(earlier.select(F.col("page_id").alias("resource_ord"), F.col("tries").alias("before"), F.col("html").isNotNull().alias("came")), "resource_ord", "left")
        asked, before = asked.where(~F.coalesce("came", F.lit(False))).drop("came"), F.coalesce("before", F.lit(0))
    asked = asked.withColumn("before", before.cast("int"))
    asked = asked if at_once is None else _lanes(asked, at_once)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                out = []
                for page, name, start, made in zip(*(c.to_pylist() for c in whole.slice(at, batch).columns), strict=True):
                    url = None if name is None else start + urllib.parse.quote(name)
                    body, n = (None, 0) if url is None or made >= tries else fetch_counted(url, tries - made, pause, timeout)
                    out.append((page, name, url, body, made + n))
                    if n and interval:
                        time.sleep(interval)
                columns = zip(*out, strict=True)
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "resource", "url", "html", "tries"])

    found = asked.select("resource_ord", "resource", "base", "before").mapInArrow(run, SCHEMA + ", tries int")
    return found if earlier is None else earlier.where("html is not null").select(*found.columns).unionByName(found)


def compose(base: str, **parameters: str) -> str:
    """An address with parameters, blanks as plus signs."""
    return base + ("?" + urllib.parse.urlencode(parameters).replace("~", "%7E") if parameters else "")


class _Names(InputPartition):
    def __init__(self, names: list[tuple[int, str]]) -> None:
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        names = list(enumerate(x for x in options["names"].split("\n") if x))
        self.base, self.pause = options["base"], float(options.get("pause", PAUSE))
        size = max(1, int(options.get("batch", 50)))
        self.parts = [_Names(names[i : i + size]) for i in range(0, len(names), size)]

    def partitions(self) -> list[InputPartition]:
        return self.parts or [_Names([])]

    def read(self, partition: _Names) -> Iterator[tuple]:
        for page, name in partition.names:
            url = self.base + urllib.parse.quote(name)
            yield page, name, url, fetch(url, pause=self.pause)


class PagesSource(DataSource):
    """``spark.read.format("factloom_pages").option("base", ...).option("names", lines)``."""

    @classmethod
    def name(cls) -> str:
        return "factloom_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
