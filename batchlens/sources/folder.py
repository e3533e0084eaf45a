"""A folder of exports of any layouts, read as one set of batches.

All files' cells are decoded once; each file's header is matched against all templates in one plan, the best
fit a file is an aggregate, and each file's cells go to the reader of its layout by a join. The number of jobs depends on the number of layouts,
not on the number of files.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchlens.functions.units import stripped
from batchlens.model import BatchFrames, cut, frames
from batchlens.sources import transposed, wide
from batchlens.sources.cells import read_export_cells, read_workbook_cells
from batchlens.sources.detect import CANDIDATES, companion_names
from batchlens.sources.tables import attach_intensities
from batchlens.sources.templates import Template, load_template

TEXTS, WORKBOOKS = "*.{[cC][sS][vV],[tT][xX][tT],[tT][sS][vV],[aA][sS][cC]}", "*.[xX][lL][sS][xXmM]"
ISOTOPES, EMISSION = "element_ascii", "agilent_oes"


@dataclass(frozen=True)
class Folder:
    """The batches of a folder, and what each file was taken for."""

    frames: BatchFrames
    #: path, reader and template (null where no layout fits), batch_id, companion (the counts file that a batch was completed from), note.
    files: DataFrame


def layouts(cells: DataFrame, templates: list[Template]) -> DataFrame:
    """path, reader, template of delimited files (``read_export_cells``); null where nothing fits.

    Of the templates with columns the one with the most analytes counts, then the fewest unmapped columns, then the fewest rows of no known
    type, then the earlier one. Files with tabs, and those named .asc, are isotope tables or nothing.
    """
    tabs = (F.col("delimiter") == "\t") | F.lower("path").endswith(".asc")
    start = F.col("row") < 12
    first = (F.col("col") == 0) & start
    files = cells.groupBy("path").agg(
        F.bool_or(tabs).alias("tabs"), F.bool_or(first & (F.lower(stripped(F.col("value"))) == "isotope")).alias("isotopes"), F.bool_or(first & F.col("value").contains(":")).alias("single"),
    )
    scores = []
    for i, t in enumerate(templates):
        got = wide.fit(cells.where(~tabs & F.array_contains("encodings", t.encoding)), t).where("analytes > 0")
        scores.append(got.select("path", F.lit(t.id).alias("template"), F.struct("analytes", -F.col("unmapped"), -F.col("strange"), F.lit(-i)).alias("score")))
    best = reduce(DataFrame.unionByName, scores).groupBy("path").agg(F.max_by("template", "score").alias("fits"))
    isotopes = F.col("tabs") & F.col("isotopes")
    reader = F.when(isotopes & F.col("single"), "isotope file").when(isotopes, "isotope summary").when(F.col("fits").isNotNull(), "wide")
    return files.join(best, "path", "left").select("path", reader.alias("reader"), F.when(isotopes, ISOTOPES).otherwise(F.col("fits")).alias("template"))


def parent(path: Column) -> Column:
    """The folder of a path."""
    return F.regexp_replace(path, "/[^/]*$", "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _mates(names: pd.Series) -> pd.Series:
    return names.map(companion_names)


def companions(files: DataFrame) -> DataFrame:
    """path, companion: of files (path) the first other one that is named as its pair, in the same folder."""
    name = F.substring_index("path", "/", -1)
    wanted = files.select("path", F.posexplode(_mates(name)).alias("rank", "mate")).select("path", "rank", F.concat(parent(F.col("path")), F.lit("/"), "mate").alias("companion"))
    found = wanted.join(files.select(F.col("path").alias("companion")), "companion")
    return found.groupBy("path").agg(F.min_by("companion", "rank").alias("companion"))


def _routed(cells: DataFrame, routes: DataFrame, reader: str, template: str) -> DataFrame:
    own = routes.where((F.col("reader") == reader) & (F.col("template") == template)).select("path")
    return cells.join(own, "path", "left_semi")


def _paired(b: BatchFrames, files: DataFrame) -> tuple[BatchFrames, DataFrame]:
    """The batches without intensities completed from their pairs, which are then no batches of their own; batch_id, companion."""
    measured = cut(b.results.groupBy("batch_id").agg(F.bool_or(F.col("intensity").isNotNull()).alias("has")))
    lacks, has = measured.where("not has").select(F.col("batch_id").alias("path")), measured.where("has").select(F.col("batch_id").alias("companion"))
    wide_files = files.where("reader = 'wide'").select("path")
    pairs = cut(companions(wide_files).join(lacks, "path", "left_semi").join(has, "companion", "left_semi").select(F.col("path").alias("batch_id"), "companion"))
    used = pairs.select(F.col("companion").alias("batch_id")).distinct()
    of = lambda df: df.withColumnRenamed("batch_id", "companion").join(pairs, "companion").select(*df.columns)
    without = lambda df: df.join(used, "batch_id", "left_anti").select(*df.columns)
    names = ("batches", "analytes", "samples", "results", "istd", "flags")
    counts, rest = BatchFrames(*(of(getattr(b, n)) for n in names)), BatchFrames(*(without(getattr(b, n)) for n in names))
    return attach_intensities(rest, counts), pairs


def read_folder(spark: SparkSession, paths: str | list[str], templates: list[str] | None = None) -> Folder:
    """All exports below a folder (or several): delimited files, isotope tables, emission workbooks.

    A wide file, a summary or a workbook is a batch; the isotope files of one sample each in a folder are one. A
    file of counts whose pair has only concentrations completes that batch. Files that no layout fits are listed without a reader.
    """
    names = [load_template(n) for n in templates or CANDIDATES]
    cells = cut(read_export_cells(spark, paths, sorted({t.encoding for t in names} | {"utf-8-sig"}), TEXTS))
    books = cut(read_workbook_cells(spark, paths, files=WORKBOOKS))
    is_emission = F.bool_or(F.lower(F.trim("sheet")).isin(*transposed.SHEETS.values()))
    book_files = books.groupBy("path").agg(F.when(F.coalesce(is_emission, F.lit(False)), "emission workbook").alias("reader"), F.max("note").alias("note"))
    routes = layouts(cells, names).withColumn("note", F.lit(None).cast("string"))
    routes = cut(routes.unionByName(book_files.withColumn("template", F.when(F.col("reader").isNotNull(), EMISSION))))

    parts = []
    for t in names:
        own = _routed(cells.where(F.array_contains("encodings", t.encoding)), routes, "wide", t.id)
        parts.append(wide.wide_frames(own, t, fits=True))
    plain = cells.where(F.array_contains("encodings", "utf-8-sig"))
    isotopes, emission = load_template(ISOTOPES), load_template(EMISSION)
    parts.append(transposed.isotope_summary_frames(_routed(plain, routes, "isotope summary", ISOTOPES), isotopes))
    parts.append(transposed.isotope_file_frames(_routed(plain, routes, "isotope file", ISOTOPES), isotopes, parent(F.col("path"))))
    parts.append(transposed.emission_frames(_routed(books, routes, "emission workbook", EMISSION), emission))
    empty = frames(spark)
    b, pairs = _paired(reduce(BatchFrames.union, parts, empty).cached(), routes)

    batch = F.when(F.col("reader") == "isotope file", parent(F.col("path"))).when(F.col("reader").isNotNull(), F.coalesce("whole", "path"))
    counted = pairs.groupBy(F.col("companion").alias("path")).agg(F.min("batch_id").alias("whole"))
    files = routes.join(counted, "path", "left").join(pairs.withColumnRenamed("batch_id", "path"), "path", "left")
    note = F.coalesce("note", F.when(F.col("reader").isNull(), "no layout fits"))
    return Folder(b, files.select("path", "reader", "template", batch.alias("batch_id"), "companion", note.alias("note")))
