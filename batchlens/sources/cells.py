"""Export files as one table of cells: path, row, col, value.

Decoding is the only step in Python; what the cells mean is DataFrame work. A byte
order mark beats the declared encoding, and bytes that don't decode are read as cp1252, with a note.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.sources.xlsx import workbook_rows

CELLS = "path string, row int, col int, value string, note string"


#: Byte order marks and what they stand for.
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def decoded(raw: bytes, encoding: str) -> tuple[str, str | None]:
    """The text, and a note where the encoding wasn't the declared one."""
    for mark, name in MARKS:
        if raw.startswith(mark):
            return raw.decode(name, "replace"), None
    try:
        return raw.decode(encoding), None
    except UnicodeDecodeError:
        pass
    try:
        return raw.decode("cp1252"), f"not valid {encoding}; read as cp1252"
    except UnicodeDecodeError:
        return raw.decode("latin-1"), f"not valid {encoding}; read as latin-1"


def read_cells(spark: SparkSession, paths: str | list[str], encoding: str = "utf-8-sig", delimiter: str = ",") -> DataFrame:
    """All cells of delimited files. ``note`` is set on a file's first cell only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in frames:
            for path, raw in zip(files["path"], files["content"]):
                text, note = decoded(bytes(raw), encoding)
                rows = [(path, r, c, v, note if r == c == 0 else None) for r, line in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)) for c, v in enumerate(line)]
                yield pd.DataFrame(rows, columns=["path", "row", "col", "value", "note"])

    paths = [paths] if isinstance(paths, str) else paths
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, CELLS)


LINES = "path string, row int, cells array<string>, note string"


def read_lines(spark: SparkSession, paths: str | list[str], encoding: str = "utf-8-sig", delimiter: str = ",", most: int = 1 << 12) -> DataFrame:
    """The same files with a row a line that has cells, ``most`` lines a batch at most; ``note`` is set on a file's first line only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "row", "cells", "note"]
        for files in frames:
            for path, raw in zip(files["path"], files["content"]):
                text, note = decoded(bytes(raw), encoding)
                rows = []
                for r, line in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)):
                    if line:
                        rows.append((path, r, line, None if r else note))
                    if len(rows) >= most:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    paths = [paths] if isinstance(paths, str) else paths
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, LINES)


def lines_of(cells: DataFrame) -> DataFrame:
    """A table of cells with a row a line."""
    ordered = F.array_sort(F.collect_list(F.struct("col", "value")))
    return cells.groupBy("path", "row").agg(ordered["value"].alias("cells"), F.max("note").alias("note"))


EXPORT_CELLS = "path string, delimiter string, encodings array<string>, row int, col int, value string, note string"


def delimiter_in(raw: bytes) -> str:
    """A tab where the first line of a file with any text has more of them than commas."""
    line = next((x for x in io.BytesIO(raw) if x.strip()), b"")
    return "\t" if line.count(b"\t") > line.count(b",") else ","


def read_export_cells(spark: SparkSession, paths: str | list[str], encodings: list[str], files: str, most: int = 1 << 16) -> DataFrame:
    """All cells of delimited files of unknown layout, whose names match the glob ``files``, folders within folders included.

    A file is decoded in each of ``encodings``; where several give the same text its cells are there once, with
    all of these. At most ``most`` cells are in a batch.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "delimiter", "encodings", "row", "col", "value", "note"]
        for files in frames:
            for path, raw in zip(files["path"], files["content"]):
                delimiter = delimiter_in(raw)
                texts: dict[tuple, list[str]] = {}
                for encoding in encodings:
                    texts.setdefault(decoded(bytes(raw), encoding), []).append(encoding)
                for (text, note), own in texts.items():
                    rows = []
                    for r, line in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)):
                        rows += [(path, delimiter, own, r, c, v, note if r == c == 0 else None) for c, v in enumerate(line)]
                        if len(rows) >= most:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                    yield pd.DataFrame(rows, columns=names)

    paths = [paths] if isinstance(paths, str) else paths
    found = spark.read.format("binaryFile").option("pathGlobFilter", files).option("recursiveFileLookup", True).load(paths)
    return found.select("path", "content").mapInPandas(run, EXPORT_CELLS)


WORKBOOK_CELLS = "path string, sheet string, row int, col int, value string, note string"


def read_workbook_cells(spark: SparkSession, paths: str | list[str], spread: bool = False, most: int = 1 << 14, files: str | None = None) -> DataFrame:
    """All cells of workbooks, with their sheets; of a file that isn't a workbook one row with a note. ``most`` cells a batch, or one row's.

    With ``files``, a glob of names, folders within folders are looked through.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "sheet", "row", "col", "value", "note"]
        for files in frames:
            for path, raw in zip(files["path"], files["content"]):
                held: list[tuple] = []
                try:
                    for sheet, row, cells in workbook_rows(io.BytesIO(raw), spread):
                        held += [(path, sheet, row, c, v, None) for c, v in cells]
                        if len(held) >= most:
                            yield pd.DataFrame(held, columns=names)
                            held = []
                except ValueError as error:
                    held.append((path, None, None, None, None, str(error)))
                yield pd.DataFrame(held, columns=names)

    paths = [paths] if isinstance(paths, str) else paths
    reader = spark.read.format("binaryFile")
    if files:
        reader = reader.option("pathGlobFilter", files).option("recursiveFileLookup", True)
    return reader.load(paths).select("path", "content").mapInPandas(run, WORKBOOK_CELLS)
