"""Exports that don't have columns for analytes: isotope tables (.asc) and emission workbooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from batchlens.functions.labels import isotope_label, line_label
from batchlens.functions.units import number, stripped
from batchlens.model import BatchFrames, cut
from batchlens.sources.cells import read_cells, read_workbook_cells
from batchlens.sources.templates import Template, load_template
from batchlens.sources.typing import by_name, by_vocabulary, level_in_name

_LEVELED = ("CAL_STD", "ICV", "CCV", "LCS")


def _num(text: Column) -> Column:
    return F.when(F.lower(stripped(text)) != "n.a.", number(text))


def _typed(s: DataFrame, t: Template, stated: Column | None = None) -> DataFrame:
    """With type, level, and whether the type is only a guess of OTHER."""
    known = [by_vocabulary(t, stated)] if stated is not None else []
    kind = F.coalesce(*known, by_name(t, F.col("name")), F.lit(t.default_sample_type or "OTHER"))
    return s.withColumn("type", kind).withColumn("level", F.when(F.col("type").isin(*_LEVELED), level_in_name(t, F.col("name"))))


def _frames(t: Template, s: DataFrame, r: DataFrame, analytes: DataFrame, warnings: DataFrame, flags: DataFrame | None = None) -> BatchFrames:
    """The canonical tables from samples (batch_id, row_pos, name, type, level, dilution_factor) and results."""
    null = lambda kind: F.lit(None).cast(kind)
    none = F.array().cast("array<string>")
    spark = s.sparkSession
    if flags is None:
        flags = spark.createDataFrame([], "batch_id string, row_pos int, flag_pos int, analyte string, metric string, value double, limit double, direction string, text string")
    batches = s.select("batch_id").distinct().join(warnings, "batch_id", "left").select(
        "batch_id", F.col("batch_id").alias("source_path"), F.lit(t.id).alias("template_id"), F.lit(t.instrument_family).alias("instrument_family"), F.lit(False).alias("flags_column_mapped"), F.coalesce("warnings", none).alias("warnings")
    )
    samples = s.select("batch_id", "row_pos", F.col("row_pos").alias("seq_index"), "name", "type", "level", null("string").alias("parent_name"), "dilution_factor", none.alias("flags"))
    istd = spark.createDataFrame([], "batch_id string, row_pos int, istd_label string, cps double")
    return BatchFrames(batches, analytes, samples, r.select("batch_id", "row_pos", "label", "conc", "unit", "intensity", F.lit(False).alias("below_dl"), null("double").alias("dl"), "rsd_pct"), istd, flags)


def _other_warnings(s: DataFrame) -> DataFrame:
    text = F.concat(F.lit("unrecognised sample name: "), "name")
    return s.where("type = 'OTHER'").groupBy("batch_id").agg(F.array_sort(F.collect_set(text)).alias("warnings"))


def read_isotope_summary(spark: SparkSession, paths: str | list[str], template: str | Template = "element_ascii") -> BatchFrames:
    """Summaries with a block of columns for each sample and a row for each isotope; one batch a file."""
    t = load_template(template) if isinstance(template, str) else template
    cells = cut(read_cells(spark, paths, "utf-8-sig", "\t"))
    if not looks_like_isotope_table(cells):
        raise ValueError(f"{paths}: no row begins with Isotope: not an isotope table")
    return isotope_summary_frames(cells, t)


def isotope_summary_frames(cells: DataFrame, t: Template) -> BatchFrames:
    """The canonical tables of the cells of summaries.

    Row 0 names the samples where their blocks start; the row that begins with Isotope names each column's measure.
    """
    cells = cells.withColumn("value", stripped(F.col("value")))
    span = W.partitionBy("path").orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    named = (F.col("value") != "") & (F.col("col") > 0)
    blocks = cells.where("row = 0").withColumn("start", F.last(F.when(named, F.col("col")), True).over(span)).withColumn("name", F.last(F.when(named, F.col("value")), True).over(span))
    width = cells.groupBy("path").agg(F.max("col").alias("w"))
    every = width.select("path", F.explode(F.sequence(F.lit(0), "w")).alias("col")).join(blocks.select("path", "col", "start", "name"), ["path", "col"], "left")
    every = every.withColumns({"start": F.last("start", True).over(span), "name": F.last("name", True).over(span)}).where("start is not null")
    head = cells.where("col = 0 and value = 'Isotope' and row < 12").groupBy("path").agg(F.min("row").alias("head"))
    measures = cells.join(head, "path").where("row = head").select("path", "col", F.lower("value").alias("measure"))
    order = W.partitionBy("path").orderBy("start")
    s = every.select("path", "start", "name").distinct().withColumn("row_pos", F.row_number().over(order))
    isotopes = cells.join(head, "path").where(f"row > head and col = 0 and value rlike '{r'^[A-Z][a-z]?[0-9]+ *[(]'}'").select("path", "row", F.col("value").alias("label"))
    body = cells.join(isotopes, ["path", "row"]).join(every, ["path", "col"]).join(measures, ["path", "col"]).join(s.select("path", "start", "row_pos"), ["path", "start"])
    got = lambda *names: _num(F.max(F.when(F.col("measure").isin(*names), F.col("value"))))
    r = body.groupBy(F.col("path").alias("batch_id"), "row_pos", "label").agg(got("concentration avg", "concentration").alias("conc"), got("intensity avg", "intensity").alias("intensity"), got("intensity rsd", "rsd").alias("rsd_pct"))
    flagged = body.where("measure = 'flags' and value not in ('', '-')").select(
        F.col("path").alias("batch_id"), "row_pos", F.lit(0).alias("flag_pos"), F.col("label").alias("analyte"), F.col("value").alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("limit"), F.lit(None).cast("string").alias("direction"), F.col("value").alias("text")
    )
    s = _typed(s.withColumn("batch_id", F.col("path")).withColumn("dilution_factor", F.lit(None).cast("double")), t, F.col("name"))
    return _frames(t, s, r.withColumn("unit", F.lit("ppb")), _isotopes(isotopes, W.partitionBy("batch_id").orderBy("row")), _other_warnings(s), flagged)


def _isotopes(rows: DataFrame, order) -> DataFrame:
    i = isotope_label(F.col("label"))
    rows = rows.select(F.col("path").alias("batch_id"), "row", "label").groupBy("batch_id", "label").agg(F.min("row").alias("row"))
    return rows.select("batch_id", F.row_number().over(order).alias("pos"), F.lit("analyte").alias("role"), "label", i["mass"].alias("mass"), i["element"].alias("element"), F.lit(None).cast("int").alias("mass_shift"), i["mode"].alias("mode"), F.lit(None).cast("double").alias("wavelength_nm"))


def looks_like_isotope_table(cells: DataFrame) -> bool:
    """Whether a table of isotopes begins in the first rows of some file."""
    return not cells.where("col = 0 and row < 12").where(F.lower(stripped(F.col("value"))) == "isotope").isEmpty()


def has_metadata(cells: DataFrame) -> bool:
    """Whether lines such as ``Data File : x`` stand at the head: then a file has one sample, else a block of columns for each."""
    return not cells.where("col = 0 and row < 12 and value like '%:%'").isEmpty()


def read_isotope_folder(spark: SparkSession, folder: str, template: str | Template = "element_ascii") -> BatchFrames:
    """A folder of files with one sample each, or one such file, is one batch, in order of acquisition (undated last, then by path)."""
    t = load_template(template) if isinstance(template, str) else template
    files = folder if folder.lower().endswith((".asc", ".txt")) else f"{folder.rstrip('/')}/*"
    return isotope_file_frames(cut(read_cells(spark, files, "utf-8-sig", "\t")), t, F.lit(folder))


def isotope_file_frames(cells: DataFrame, t: Template, batch: Column) -> BatchFrames:
    """The canonical tables of the cells of files with one sample each; ``batch`` gives a file's batch by its path."""
    cells = cells.withColumn("value", stripped(F.col("value")))
    head = cells.where("value = 'Isotope'").groupBy("path").agg(F.max("row").alias("head"))
    meta = cells.join(head, "path").where("row < head").groupBy("path", "row").agg(F.max(F.when(F.col("col") == 0, F.col("value"))).alias("k"), F.min_by(F.when((F.col("col") > 0) & (F.col("value") != ""), F.col("value")), F.when((F.col("col") > 0) & (F.col("value") != ""), F.col("col"))).alias("v"))
    word = F.lower(stripped(F.substring_index("k", ":", 1)))
    of = lambda name: F.max(F.when(word == name, F.nullif("v", F.lit("")))).alias(name.replace(" ", "_"))
    m = head.join(meta, "path").groupBy("path").agg(*(of(x) for x in ("sample name", "data file", "analysis date", "analysis type", "dilution factor")))
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^\\/]+)$", 1), r"\.[^.]*$", "")
    when = F.try_to_timestamp(F.regexp_replace("analysis_date", r"^[A-Za-z]{3},\s*", ""), F.lit("dd-MMM-yyyy HH:mm:ss"))
    order = W.orderBy(F.col("at").asc_nulls_last(), "path").partitionBy("batch_id")
    s = m.withColumns({"batch_id": batch, "at": when, "name": F.coalesce("sample_name", stem(F.col("data_file")), stem(F.col("path")))}).withColumn("row_pos", F.row_number().over(order))
    s = _typed(s.withColumn("dilution_factor", number(F.col("dilution_factor"))), t, F.coalesce("analysis_type", F.lit("")))
    measures = cells.join(head, "path").where("row = head").select("path", "col", F.lower("value").alias("measure"))
    isotopes = cells.join(head, "path").where("row > head and col = 0 and value rlike '^[A-Z][a-z]?[0-9]+ *[(]'").select("path", "row", F.col("value").alias("label"))
    body = cells.join(isotopes, ["path", "row"]).join(measures, ["path", "col"]).join(s.select("path", "row_pos", "batch_id"), "path")
    got = lambda *names: _num(F.max(F.when(F.col("measure").isin(*names), F.col("value"))))
    r = body.groupBy("batch_id", "row_pos", "label").agg(got("concentration avg", "concentration").alias("conc"), got("intensity avg", "intensity").alias("intensity"), got("intensity rsd").alias("rsd_pct"))
    errors = body.where("measure = 'error' and value not in ('', '-')").select(
        "batch_id", "row_pos", F.lit(0).alias("flag_pos"), F.col("label").alias("analyte"), F.col("value").alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("limit"), F.lit(None).cast("string").alias("direction"), F.col("value").alias("text")
    )
    seen = isotopes.withColumn("path", batch)
    skipped = cells.select("path").distinct().join(head, "path", "left_anti").withColumn("batch_id", batch)
    skipped = skipped.groupBy("batch_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("file skipped, no isotope table: "), "path"))).alias("warnings"))
    return _frames(t, s, r.withColumn("unit", F.lit("ppb")), _isotopes(seen, W.partitionBy("batch_id").orderBy("row", "label")), skipped, errors)


# The names of the sheets, those of concentrations in the order in which they are looked for.
SHEETS = {"conc": "conc. in sample units", "conc2": "conc. in calib units", "intensity": "corrected intensities", "rsd_pct": "corrected intensities rsds"}


def _kind_of_sheet() -> Column:
    sheet = F.lower(F.trim(F.col("sheet")))
    return F.coalesce(*[F.when(sheet == v, k) for k, v in SHEETS.items()])


def looks_like_emission_workbook(cells: DataFrame) -> bool:
    """Whether some sheet has a name of the layout."""
    return not cells.where(_kind_of_sheet().isNotNull()).isEmpty()


def sheet_lines(cells: DataFrame) -> DataFrame:
    """path, kind, sheet, col, label, element, wavelength_nm, unit: the emission lines that the sheets' heads name."""
    heads = cells.where("row = 0").withColumn("kind", _kind_of_sheet()).where("kind is not null")
    heads = heads.select("path", "kind", "sheet", "col", line_label(stripped(F.regexp_replace("value", r"\s+", " "))).alias("l"))
    return heads.where("l.label is not null").select("path", "kind", "sheet", "col", "l.*")


def sheet_agreement(cells: DataFrame) -> DataFrame:
    """path, primary, kind, sheet, agrees: whether a sheet has the lines of its workbook's primary sheet, at the same columns.

    The primary sheet is that of concentrations, else of intensities. The lists are aligned column by column, so a
    line that only one of the two has counts as a difference, and so does another line at its place.
    """
    sheets = cells.withColumn("kind", _kind_of_sheet()).where("kind is not null").groupBy("path", "kind").agg(F.min("sheet").alias("sheet"))
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(SHEETS)])
    primary = sheets.groupBy("path").agg(F.min_by("kind", rank).alias("primary"))
    others = sheets.join(primary, "path").where("kind <> primary")
    lines = sheet_lines(cells)
    own = lines.join(others.select("path", "kind"), ["path", "kind"]).select("path", "kind", "col", F.col("label").alias("own"))
    first = lines.join(others.select("path", F.col("primary").alias("kind"), F.col("kind").alias("other")), ["path", "kind"]).select("path", F.col("other").alias("kind"), "col", F.col("label").alias("first"))
    differ = own.join(first, ["path", "kind", "col"], "full").groupBy("path", "kind").agg(F.bool_and(F.col("own").eqNullSafe(F.col("first"))).alias("agrees"))
    return others.join(differ, ["path", "kind"], "left").select("path", "primary", "kind", "sheet", F.coalesce("agrees", F.lit(True)).alias("agrees"))


def emission_frames(cells: DataFrame, t: Template) -> BatchFrames:
    """The canonical tables of emission workbooks from their cells (path, sheet, row, col, value): a sheet a measure, a sample a row.

    Names, lines and units are those of the primary sheet; sheets that list other lines are left out, with a warning.
    """
    clean = stripped(F.regexp_replace(F.coalesce("value", F.lit("")), r"\s+", " "))
    cells = cells.withColumn("kind", _kind_of_sheet()).where("kind is not null").withColumn("value", clean)
    agreement = sheet_agreement(cells)
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(SHEETS)])
    primary = cells.groupBy("path").agg(F.min_by("kind", rank).alias("kind"))
    lines = sheet_lines(cells).join(primary, ["path", "kind"])
    columns = F.col("value") == "Sample Id"
    at = cells.where("row = 0").where(columns).join(primary, ["path", "kind"]).groupBy("path", "kind").agg(F.min("col").alias("col"))
    first = cells.where("row > 0").join(primary, ["path", "kind"])
    named = first.join(at, ["path", "kind", "col"]).where("value <> ''").select("path", "row", F.col("value").alias("stated"))
    filled = first.join(lines.select("path", "kind", "col"), ["path", "kind", "col"]).where(_num(F.col("value")).isNotNull()).select("path", "row").distinct()
    rows = filled.join(named, ["path", "row"], "full").join(at.select("path"), "path", "left_semi")  # a row without a name or a number is padding
    s = rows.select("path", "row", F.coalesce("stated", F.concat(F.lit("row"), F.col("row").cast("string"))).alias("name"))
    s = s.withColumn("batch_id", F.col("path")).withColumn("row_pos", F.row_number().over(W.partitionBy("path").orderBy("row"))).withColumn("dilution_factor", F.lit(None).cast("double"))
    used = primary.unionByName(agreement.where("agrees and kind <> 'conc2'").select("path", "kind"))
    body = cells.where("row > 0").join(used, ["path", "kind"]).join(lines.select("path", "col", "label", "unit"), ["path", "col"]).join(s.select("path", "row", "row_pos"), ["path", "row"])
    got = lambda *kinds: _num(F.max(F.when(F.col("kind").isin(*kinds), F.col("value"))))
    unit = F.coalesce(F.max(F.when(F.lower("unit") != "cps", F.col("unit"))), F.lit(t.columns.get("unit", "ppb")))
    r = body.groupBy(F.col("path").alias("batch_id"), "row_pos", "label").agg(got("conc", "conc2").alias("conc"), got("intensity").alias("intensity"), got("rsd_pct").alias("rsd_pct"), unit.alias("unit"))
    order = W.partitionBy("batch_id").orderBy("col")
    a = lines.groupBy(F.col("path").alias("batch_id"), "label", "element", "wavelength_nm").agg(F.min("col").alias("col"))
    a = a.select("batch_id", F.row_number().over(order).alias("pos"), F.lit("analyte").alias("role"), "label", F.lit(None).cast("int").alias("mass"), "element", F.lit(None).cast("int").alias("mass_shift"), F.lit(None).cast("string").alias("mode"), "wavelength_nm")
    s = _typed(s, t)
    skipped = agreement.where("not agrees").select(F.col("path").alias("batch_id"), F.concat(F.lit("sheet '"), "sheet", F.lit("' lists different emission lines and was skipped")).alias("w"))
    none = F.array().cast("array<string>")
    skipped = skipped.groupBy("batch_id").agg(F.array_sort(F.collect_set("w")).alias("w"))
    warnings = skipped.join(_other_warnings(s), "batch_id", "full").select("batch_id", F.concat(F.coalesce("w", none), F.coalesce("warnings", none)).alias("warnings"))
    return _frames(t, s, r, a, warnings)


def read_emission_workbook(spark: SparkSession, paths: str | list[str], template: str | Template = "agilent_oes") -> BatchFrames:
    """Emission workbooks, one batch each."""
    t = load_template(template) if isinstance(template, str) else template
    cells = cut(read_workbook_cells(spark, paths))
    if not looks_like_emission_workbook(cells):
        raise ValueError(f"{paths}: no sheet of concentrations or intensities: not an emission workbook")
    return emission_frames(cells, t)
