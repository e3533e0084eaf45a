"""Exports with a row a sample and columns for each analyte, under one header row or two."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from batchlens.functions.labels import mass_label
from batchlens.functions.units import number, parsed_concentration, stripped
from batchlens.model import BatchFrames, cut
from batchlens.sources.cells import lines_of, read_lines
from batchlens.sources.tables import collapsed_headers, instrument_objections
from batchlens.sources.templates import Template, classify, load_template
from batchlens.sources.typing import by_vocabulary, level_in_name, parent_of

_LEVELED = ("CAL_STD", "ICV", "CCV", "LCS", "MS", "MSD")


def headers(cells: DataFrame, t: Template) -> DataFrame:
    """path, col, name of the header."""
    if t.header_rows == 1:
        return cells.where("row = 0").select("path", "col", stripped(F.col("value")).alias("name"))
    two = cells.where("row < 2").groupBy(F.col("path").alias("file"), "col").agg(F.max(F.when(F.col("row") == 0, F.col("value"))).alias("top"), F.max(F.when(F.col("row") == 1, F.col("value"))).alias("sub"))
    return collapsed_headers(two, list(t.header_group_labels)).withColumnRenamed("file", "path")


def classified(names: DataFrame, t: Template) -> DataFrame:
    """name, kind, label, unit of the distinct header names of all files, by the template's patterns."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame(classify(t, f["name"].tolist()), columns=["name", "kind", "label", "unit"])

    return names.select("name").distinct().mapInPandas(run, "name string, kind string, label string, unit string")


def columns(cells: DataFrame, t: Template) -> DataFrame:
    """path, col, name, kind, label, unit of each column; of columns with one name or one label and kind the last counts."""
    heads = headers(cells, t)
    last = W.partitionBy("path", "kind", F.coalesce("label", "name")).orderBy(F.desc("col"))
    return heads.join(classified(heads, t), "name").withColumn("i", F.row_number().over(last)).where("i = 1 or kind = 'unmapped'").drop("i")


def read_wide(spark: SparkSession, paths: str | list[str], template: str | Template = "masshunter_quant_wide") -> BatchFrames:
    """One batch a file. Raises ValueError where a file has no column of concentrations or counts."""
    t = load_template(template) if isinstance(template, str) else template
    return _frames(cut(read_lines(spark, paths, t.encoding)), t)


def read_wide_results(spark: SparkSession, paths: str | list[str], template: str | Template = "masshunter_quant_wide") -> DataFrame:
    """The results of ``read_wide``, each with its sample's name, type and level: a line's results never leave their line, so nothing is joined back."""
    t = load_template(template) if isinstance(template, str) else template
    _, s = _samples(cut(read_lines(spark, paths, t.encoding)), t)
    return s.where("not padding").select(F.col("path").alias("batch_id"), "row_pos", "name", "type", F.col("lv").alias("level"), F.inline("measures"))


def fit(cells: DataFrame, t: Template) -> DataFrame:
    """path, analytes, unmapped, strange: how well a template fits each file, by its columns and its rows of no known type."""
    cols = columns(cells, t)
    kinds = {k: F.count_distinct(F.when(F.col("kind") == k, F.col("label"))) for k in ("conc", "cps")}
    unmapped = F.count_distinct(F.when(F.col("kind") == "unmapped", F.col("name")))
    heads = cols.groupBy("path").agg(F.when(kinds["conc"] > 0, kinds["conc"]).otherwise(kinds["cps"]).alias("analytes"), unmapped.alias("unmapped"))
    own = by_vocabulary(t, stripped(F.col("value")))
    types = cols.where("kind = 'sample_type'").select("path", "col")
    strange = cells.where(F.col("row") >= t.header_rows).join(types, ["path", "col"]).groupBy("path").agg(F.count_if(own.isNull() | (own == "OTHER")).alias("strange"))
    return heads.join(strange, "path", "left").select("path", "analytes", "unmapped", F.coalesce("strange", F.lit(0)).alias("strange"))


def wide_frames(cells: DataFrame, t: Template, fits: bool = False) -> BatchFrames:
    """The canonical tables of the cells of wide exports. Unless they are known to fit, a file without analytes is a ValueError."""
    return _frames(lines_of(cells), t, fits)


_TEXTS = ("seq", "sample_name", "sample_type", "level", "flags")


def _places(cols: DataFrame) -> DataFrame:
    """A row a file: where its texts, its measures (by label) and its internal standards are."""
    mapped = cols.where("kind not in ('unmapped', 'ignored')")
    at = lambda k: F.max(F.when(F.col("kind") == k, F.col("col")))
    labelled = mapped.where("kind in ('conc', 'cps', 'rsd')").groupBy("path", "label").agg(at("conc").alias("conc"), at("cps").alias("cps"), at("rsd").alias("rsd"), F.max(F.when(F.col("kind") == "conc", F.col("unit"))).alias("unit"))
    measured = labelled.groupBy("path").agg(F.collect_list(F.struct("label", "conc", "cps", "rsd", "unit")).alias("m"), F.bool_or(F.col("conc").isNotNull()).alias("has_conc"))
    analytes = F.filter("m", lambda x: x["label"].isNotNull() & F.when(F.col("has_conc"), x["conc"].isNotNull()).otherwise(x["cps"].isNotNull()))
    istds = F.collect_list(F.when(F.col("kind") == "istd", F.struct("label", "col"))).alias("istds")
    texts = mapped.groupBy("path").agg(F.min("col").alias("first_col"), istds, *(F.collect_list(F.when(F.col("kind") == k, F.col("col"))).alias(f"{k}_cols") for k in _TEXTS))
    return texts.join(measured.select("path", analytes.alias("m")), "path", "left")


def _samples(lines: DataFrame, t: Template, fits: bool = False) -> tuple[DataFrame, DataFrame]:
    """The files' columns, and a row a line below the header: its sample, its results (``measures``) and its internal standards.

    Lines are gathered by file once; all that a line says is made of its own cells.
    """
    cols = cut(columns(lines.where(F.col("row") < t.header_rows).select("path", "row", F.posexplode("cells").alias("col", "value")), t))
    found = cols.groupBy("path").agg(F.bool_or(F.col("kind").isin("conc", "cps")).alias("ok"))
    bad = [] if fits else [r["path"] for r in found.where("not ok").limit(5).collect()]
    if bad:
        raise ValueError(f"no analyte columns matched template {t.id!r}: {', '.join(bad)}")
    body = lines.where(F.col("row") >= t.header_rows).where(F.exists("cells", lambda x: F.trim(x) != "")).select("path", "row", "cells")
    s = body.join(_places(cols).hint("shuffle_merge"), "path", "left")
    n, cell = F.size("cells"), lambda at: F.get("cells", at)
    text = lambda k: F.when(F.col("first_col") < n, stripped(F.coalesce(F.array_max(F.transform(f"{k}_cols", cell)), F.lit(""))))
    within = lambda at: F.coalesce(at < n, F.lit(False))
    there = F.filter("m", lambda x: within(x["conc"]) | within(x["cps"]) | within(x["rsd"]))
    raw = F.transform(there, lambda x: F.struct(x["label"].alias("label"), cell(x["conc"]).alias("conc"), F.coalesce(F.when(within(x["conc"]), x["unit"]), F.lit("ppb")).alias("unit"), cell(x["cps"]).alias("cps"), cell(x["rsd"]).alias("rsd")))
    standards = F.transform(F.filter("istds", lambda x: x["col"] < n), lambda x: F.struct(x["label"].alias("istd_label"), number(cell(x["col"])).alias("cps")))
    s = s.select("path", "row", *(text(k).alias(k) for k in _TEXTS), raw.alias("raw"), standards.alias("standards"))

    def parsed(x):
        c = parsed_concentration(x["conc"])
        return F.struct(x["label"].alias("label"), c["conc"].alias("conc"), x["unit"].alias("unit"), number(x["cps"]).alias("intensity"), c["below_dl"].alias("below_dl"), c["dl"].alias("dl"), number(x["rsd"]).alias("rsd_pct"))

    s = s.withColumn("measures", F.transform("raw", parsed)).drop("raw")
    s = s.withColumn("i", F.row_number().over(W.partitionBy("path").orderBy("row")))
    s = s.withColumns({"name": F.coalesce(F.nullif("sample_name", F.lit("")), F.concat(F.lit("row"), F.col("i").cast("string"))), "type": F.coalesce(by_vocabulary(t, F.col("sample_type")), F.lit("OTHER"))})
    stated = F.lit(None).cast("double") if t.level_is_index else number(F.col("level"))
    level = F.coalesce(stated, F.when(F.col("type").isin(*_LEVELED), level_in_name(t, F.col("name"))))
    s = s.withColumns({"lv": level, "seq_index": F.coalesce(F.nullif(number(F.col("seq")).cast("int"), F.lit(0)), F.col("i")), "parent_name": parent_of(t, F.col("type"), F.col("name"))})
    has = F.coalesce(F.exists("measures", lambda x: x["conc"].isNotNull() | x["below_dl"] | x["intensity"].isNotNull()), F.lit(False))
    padding = (F.col("type") == "OTHER") & (F.coalesce("sample_type", F.lit("")) == "") & F.lower("name").startswith("row") & ~has
    s = s.withColumn("padding", padding)
    return cols, s.withColumn("row_pos", F.row_number().over(W.partitionBy("path", "padding").orderBy("seq_index", "row")))


def _frames(lines: DataFrame, t: Template, fits: bool = False) -> BatchFrames:
    cols, every = _samples(lines, t, fits)
    every = cut(every)
    s = every.where("not padding")
    both = cols.groupBy("path").agg(F.bool_or(F.col("kind") == "conc").alias("has_conc"))
    labels = cols.where("kind in ('conc', 'cps')").join(both, "path").where("not has_conc or kind = 'conc'").groupBy("path", "label").agg(F.min("col").alias("first"))
    dropped = every.where("padding").groupBy("path").agg(F.count("*").alias("n_padding"))
    positions = lambda d, k: d.select("path", "label", F.row_number().over(W.partitionBy("path").orderBy("first")).alias("pos"), F.lit(k).alias("role"))
    istds = cols.where("kind = 'istd'").groupBy("path", "label").agg(F.min("col").alias("first"))
    m = mass_label(F.col("label"))
    analytes = positions(labels, "analyte").unionByName(positions(istds, "istd")).select(
        F.col("path").alias("batch_id"), "pos", "role", "label", m["mass"].alias("mass"), m["element"].alias("element"), m["mass_shift"].alias("mass_shift"), m["mode"].alias("mode"), F.lit(None).cast("double").alias("wavelength_nm")
    )
    blobs = s.where("coalesce(flags, '') <> ''").select(F.col("path").alias("batch_id"), "row_pos", F.col("flags").alias("blob"))
    flags = instrument_objections(blobs, "blob", labels.select(F.col("path").alias("batch_id"), "label"))
    flags = flags.select("batch_id", "row_pos", "flag_pos", "analyte", "metric", "value", "limit", "direction", F.col("objection").alias("text"))
    unmapped = cols.where("kind = 'unmapped'").groupBy("path").agg(F.array_sort(F.collect_set(F.concat(F.lit("unmapped column ignored: "), "name"))).alias("w1"))
    strange = s.where(by_vocabulary(t, F.col("sample_type")).isNull()).groupBy("path").agg(F.array_sort(F.collect_set(F.concat(F.lit("unrecognised sample type: "), "sample_type"))).alias("w2"))
    notes = lines.where("note is not null").groupBy("path").agg(F.array_sort(F.collect_set("note")).alias("w3"))
    none = F.array().cast("array<string>")
    padded = F.when(F.col("n_padding") > 0, F.array(F.concat(F.col("n_padding").cast("string"), F.lit(" empty row(s) dropped")))).otherwise(none)
    files = both.join(unmapped, "path", "left").join(strange, "path", "left").join(notes, "path", "left").join(dropped, "path", "left")
    batches = files.select(
        F.col("path").alias("batch_id"), F.col("path").alias("source_path"), F.lit(t.id).alias("template_id"), F.lit(t.instrument_family).alias("instrument_family"), F.lit("flags" in t.columns).alias("flags_column_mapped"),
        F.concat(F.coalesce("w3", none), F.coalesce("w1", none), F.coalesce("w2", none), padded).alias("warnings"),
    )
    raw = F.when(F.coalesce("flags", F.lit("")) != "", F.array("flags")).otherwise(none)
    samples = s.select(F.col("path").alias("batch_id"), "row_pos", "seq_index", "name", "type", F.col("lv").alias("level"), "parent_name", F.lit(None).cast("double").alias("dilution_factor"), raw.alias("flags"))
    results = s.select(F.col("path").alias("batch_id"), "row_pos", F.inline("measures")).select("batch_id", "row_pos", "label", "conc", "unit", "intensity", "below_dl", "dl", "rsd_pct")
    istd = s.select(F.col("path").alias("batch_id"), "row_pos", F.inline("standards")).where("cps is not null")
    return BatchFrames(batches, analytes, samples, results, istd, flags)
