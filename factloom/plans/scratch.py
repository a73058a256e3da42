"""Scratch tables in the folder that all executors share.

A plan that is used more than once, or that grows round by round, is written
as Parquet and read again: its lineage ends there, and the loss of an executor
costs nothing. The folder is the one that ``spark.checkpoint.dir`` names; only
where the session names none and runs on one machine (tests, a laptop) is a
local one made. A cluster without a shared folder is refused.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, or one of our own where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="factloom-"))
        atexit.register(shutil.rmtree, _made[0], ignore_errors=True)
    return f"file://{_made[0]}"


class Scratch:
    """The scratch tables of one run; ``drop`` removes those no longer read.

    What is left goes when the program ends, as results are read from it until then.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.paths: dict[int, str] = {}
        atexit.register(self._clean)

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        """Delete all tables at once, when nothing reads them any more."""
        if self.count:
            self._delete(self.root)
        self.paths.clear()
        atexit.unregister(self._clean)

    def _clean(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            if self.count and not self.spark.sparkContext._jsc.sc().isStopped():
                self._delete(self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read from the written files."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(saved)] = path
        return saved

    def clear(self, *kept: DataFrame) -> None:
        """Delete all tables but those of ``kept``."""
        stay = {id(x) for x in kept}
        for key in [k for k in self.paths if k not in stay]:
            self._delete(self.paths.pop(key))

    def drop(self, saved: DataFrame) -> None:
        """Delete a table that ``save`` returned."""
        path = self.paths.pop(id(saved), None)
        if path is not None:
            self._delete(path)
