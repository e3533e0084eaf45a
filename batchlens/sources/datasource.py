"""Exports as Spark data sources, in batches and as a stream of a growing folder.

``spark.read.format("labcells")`` gives the cells of delimited files (``row`` and ``col`` from 0), and
``format("labwide")`` those of one layout with what each column holds: path, row, col, name, kind, label, unit, value. Files are opened by the
tasks and read as a stream of lines, so no file is held whole. A partition is files of about ``partitionBytes``
together; a batch has at most ``batchRows`` cells.

``readStream`` takes files in order of change: an offset is the change time and path of the last file taken. Files that changed within the last
``settle`` seconds wait, so that half-written ones aren't read; files that come with an older time stamp than the last offset aren't seen.

Options: path (a file, folder or glob; local or a URI of a store that pyarrow opens), encoding, delimiter (else a
tab or comma by the first line), template (of labwide), partitionBytes, batchRows, settle, filesPerBatch.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from batchlens.sources.cells import MARKS
from batchlens.sources.templates import Template, classify, collapse, load_template

CELLS = "path string, row int, col int, value string"
WIDE = "path string, row int, col int, name string, kind string, label string, unit string, value string"


@dataclass(frozen=True)
class Found:
    """A file: its change time in nanoseconds, path and size."""

    changed: int
    path: str
    size: int


@dataclass
class Files(InputPartition):
    """The files of a task."""

    paths: list[str]


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    kind = urlparse(path).scheme
    if kind in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path if kind else path
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[Found]:
    """The files of a path, a folder (and those below it) or a glob in the last part, by change time."""
    store, place = store_of(path)
    head, _, tail = place.rpartition("/")
    glob = tail if any(c in tail for c in "*?[") else None
    info = store.get_file_info(head if glob else place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    every = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(info.path, recursive=not glob))
    kept = [f for f in every if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and (not glob or fnmatch.fnmatchcase(f.base_name, glob))]
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    return sorted((Found(f.mtime_ns or 0, prefix + f.path, f.size or 0) for f in kept), key=lambda f: (f.changed, f.path))


def _split(files: list[Found], most: int) -> list[Files]:
    """The files dealt to tasks of about ``most`` bytes."""
    out, size = [], most
    for f in files:
        if size >= most:
            out.append(Files([]))
            size = 0
        out[-1].paths.append(f.path)
        size += f.size
    return out


def lines(path: str, encoding: str, delimiter: str | None) -> Iterator[list[str]]:
    """The rows of a delimited file, read as a stream. A byte order mark beats ``encoding``; what doesn't decode is replaced."""
    store, place = store_of(path)
    with store.open_input_stream(place) as raw:
        buffered = io.BufferedReader(raw, 1 << 20)
        start = buffered.peek(1 << 16)
        known = next((name for mark, name in MARKS if start.startswith(mark)), encoding)
        if delimiter is None:
            line = next((x for x in start.splitlines() if x.strip()), b"")
            delimiter = "\t" if line.count(b"\t") > line.count(b",") else ","
        yield from csv.reader(io.TextIOWrapper(buffered, known, "replace", newline=""), delimiter=delimiter)


class _Reader:
    """What both readers share: options, and the batches of a task's files."""

    def __init__(self, options: dict, wide: bool):
        self.path = options.get("path") or options.get("paths", "")
        if not self.path:
            raise ValueError("a path is needed")
        self.bytes, self.rows = int(options.get("partitionbytes", 64 << 20)), int(options.get("batchrows", 1 << 16))
        self.settle, self.per_batch = float(options.get("settle", 2)), int(options.get("filesperbatch", 1000))
        self.template: Template | None = load_template(options.get("template", "masshunter_quant_wide")) if wide else None
        self.encoding = options.get("encoding") or (self.template.encoding if wide else "utf-8-sig")
        self.delimiter = options.get("delimiter") or ("," if wide else None)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int32() if k == "int" else pa.string()) for n, k in (c.split() for c in (WIDE if self.template else CELLS).split(", "))])
        held: list[tuple] = []
        for path in partition.paths:
            for row in self._rows(path):
                held += row
                while len(held) >= self.rows:
                    yield _batch(held[: self.rows], schema)
                    held = held[self.rows :]
        if held:
            yield _batch(held, schema)

    def _rows(self, path: str) -> Iterator[list[tuple]]:
        rows = enumerate(lines(path, self.encoding, self.delimiter))
        if not self.template:
            yield from ([(path, r, c, v) for c, v in enumerate(line)] for r, line in rows)
            return
        t, heads = self.template, []
        kinds: list[tuple] = []
        for r, line in rows:
            if r < t.header_rows:
                heads.append(line)
                if r == t.header_rows - 1:
                    kinds = classify(t, collapse(heads, t.header_group_labels))
                continue
            yield [(path, r, c, *kinds[c], v) for c, v in enumerate(line) if c < len(kinds) and kinds[c][1] not in ("unmapped", "ignored")]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class _BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Files]:
        return _split(listed(self.path), self.bytes)


class _StreamReader(_Reader, DataSourceStreamReader):
    """Offsets are the change time and path of the last file taken."""

    def __init__(self, options: dict, wide: bool):
        super().__init__(options, wide)
        self.at: tuple[int, str] = (-1, "")

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        ready = time.time_ns() - int(self.settle * 1e9)
        new = [f for f in listed(self.path) if f.changed <= ready and (f.changed, f.path) > self.at][: self.per_batch]
        if new:
            self.at = (new[-1].changed, new[-1].path)
        return {"changed": self.at[0], "path": self.at[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((x["changed"], x["path"]) for x in (start, end))
        self.at = max(self.at, high)  # after a restart too
        return _split([f for f in listed(self.path) if low < (f.changed, f.path) <= high], self.bytes)

    def commit(self, end: dict) -> None:
        pass


class LabCells(DataSource):
    """The cells of delimited files."""

    wide = False

    @classmethod
    def name(cls) -> str:
        return "labcells"

    def schema(self) -> str:
        return WIDE if self.wide else CELLS

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(dict(self.options), self.wide)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options), self.wide)


class LabWide(LabCells):
    """The cells of exports of one layout, with what their columns hold."""

    wide = True

    @classmethod
    def name(cls) -> str:
        return "labwide"


def register(spark: SparkSession) -> None:
    """Make ``labcells`` and ``labwide`` known to a session."""
    spark.dataSource.register(LabCells)
    spark.dataSource.register(LabWide)
