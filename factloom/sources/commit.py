"""A sink of lines that commits: ``format("factloom_lines")``, for batches and streams.

Tasks write their lines to a folder of the job beside the result, and name their
file to the driver. When all are done the driver drops what no task named, as an
attempt that was lost leaves it, and moves the folder to ``path/run=NAME`` in one
step: readers see all of a run or nothing of it. A job that fails leaves nothing.
A run whose name is there already is a repeat, and changes nothing; a stream's
runs are named by its batches. The file system needs folders that can be moved
(a shared disk, HDFS), and is the same for the driver and all tasks.

Lines are made inside the JVM; Python sees Arrow batches of them, one at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

#: Begin of the name of a folder of what is not committed yet; readers pass over such names.
STAGED = "_staged-"
#: File of a committed run that says how many rows and files it has.
COMMITTED = "_committed"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").strip("/")
    return fs.FileSystem.from_uri(path.rstrip("/"))


def _is_there(files: fs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type != fs.FileType.NotFound


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: the name of its file, None for no rows, and the number of rows."""

    file: str | None
    rows: int


class _Lines:
    """Staging, committing and dropping; the writers below say when.

    The folder is made before the tasks start, so that one that outlives its job
    finds it gone. A stream's batches, one after another, share one: who commits there is not the
    object that the tasks have, and what a lost batch left goes with the next.
    """

    def __init__(self, path: str, run: str | None = None, overwrite: bool = False, stream: bool = False) -> None:
        self.path, self.overwrite = path, overwrite
        self.job = "stream" if stream else uuid.uuid4().hex
        self.run = self.job if run is None else run
        if not re.fullmatch(r"[\w.-]+", self.run):
            raise ValueError(f"a run is named by letters, digits and _ . - only: {self.run!r}")
        if not stream:
            files, _, staged = self._places()
            files.create_dir(staged, recursive=True)

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        files, root = file_system(self.path)
        return files, root, f"{root}/{STAGED}{self.job}"

    def stage(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, _, staged = self._places()
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.txt"
        rows, out = 0, None
        try:
            for batch in batches:
                lines = batch.column(0).drop_null().cast(pa.large_string())
                if not len(lines):
                    continue
                if out is None:
                    if self.job == "stream":
                        files.create_dir(staged, recursive=True)
                    out = files.open_output_stream(f"{staged}/{name}")
                rows += len(lines)
                ended = pc.binary_join_element_wise(lines, *(pa.scalar(x, lines.type) for x in ("", "\n")))  # the bytes of all its texts lie side by side
                end = int(np.frombuffer(ended.buffers()[1], np.int64)[len(ended)])
                out.write(ended.buffers()[2][:end])
        finally:
            if out is not None:
                out.close()
        return Written(name if rows else None, rows)

    def finish(self, messages: list[Written | None], run: str) -> None:
        files, root, staged = self._places()
        target = f"{root}/run={run}"
        if _is_there(files, target) and not self.overwrite:
            return self.drop()
        files.create_dir(staged, recursive=True)
        named = {m.file for m in messages if m is not None and m.file}
        for found in files.get_file_info(fs.FileSelector(staged)):
            if found.base_name not in named:
                files.delete_file(found.path)
        with files.open_output_stream(f"{staged}/{COMMITTED}") as out:
            out.write(json.dumps({"rows": sum(m.rows for m in messages if m is not None), "files": len(named)}).encode())
        before = [x.path for x in files.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("run=")] if self.overwrite else []
        for old in (x for x in before if x.endswith(f"/run={run}")):
            files.delete_dir(old)
        files.move(staged, target)
        for old in (x for x in before if not x.endswith(f"/run={run}")):
            files.delete_dir(old)

    def drop(self) -> None:
        files, _, staged = self._places()
        if _is_there(files, staged):
            files.delete_dir(staged)


class _Writer(_Lines, DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.stage(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.finish(messages, self.run)

    def abort(self, messages: list[Written | None]) -> None:
        self.drop()


class _StreamWriter(_Lines, DataSourceStreamArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.stage(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.finish(messages, str(batchId))

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.drop()


class LinesSink(DataSource):
    """``format("factloom_lines")``, mode ``append`` or ``overwrite``, option ``run``; one column of text, of which nulls are left out.

    Without a name a run is always new. ``overwrite`` puts a run in place of all that
    there are; the others go once it is there. A stream's runs are named by its batches.
    """

    @classmethod
    def name(cls) -> str:
        return "factloom_lines"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("run"), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(self.options["path"], stream=True)


def commit_lines(lines: DataFrame, path: str, run: str | None = None, mode: str = "append") -> None:
    """Write ``lines`` (value) as a run below ``path``: all of it, or nothing; a run that is there stays as it is."""
    lines.sparkSession.dataSource.register(LinesSink)
    if run is not None and mode == "append":
        files, root = file_system(path)
        if _is_there(files, f"{root}/run={run}"):  # a repeat, whose lines need not be made
            return
    named = {} if run is None else {"run": run}
    lines.select("value").write.format(LinesSink.name()).options(**named).mode(mode).save(path)
