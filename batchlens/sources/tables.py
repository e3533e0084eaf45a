"""Reading steps that work on tables of cells: headers of two rows, objections in one cell, companion files."""

from __future__ import annotations

import re
from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchlens.functions.units import stripped
from batchlens.model import BatchFrames

def collapsed_headers(headers: DataFrame, group_labels: list[str]) -> DataFrame:
    """file, col, name: one logical name for each column of a header of two rows (file, col, top, sub).

    A top cell spans the columns to its right until the next; ``group_labels`` are spans that don't prefix.
    """
    clean = lambda c: stripped(F.coalesce(c, F.lit("")))
    top = F.when(clean(F.col("top")).rlike(r"^Unnamed:\s*\d+$"), "").otherwise(clean(F.col("top")))
    span = W.partitionBy("file").orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    rows = headers.select("file", "col", top.alias("top"), clean(F.col("sub")).alias("sub")).withColumn("cur", F.last(F.nullif("top", F.lit("")), ignorenulls=True).over(span))
    group = F.coalesce(F.col("cur").isin(*group_labels), F.lit(False))
    bare = F.when(group, F.col("cur")).when(F.col("top") == "", F.format_string("(unnamed column %d)", "col")).otherwise(F.col("cur"))
    name = F.when(F.col("sub") == "", bare).when(F.col("cur").isNull() | group, F.col("sub")).otherwise(F.concat_ws(" :: ", "cur", "sub"))
    return rows.select("file", "col", name.alias("name"))


#: What an instrument says of a result, the direction, and whether a limit follows.
OBJECTIONS = {
    "over the allowed maximum": ("high", True),
    "below the allowed minimum": ("low", True),
    "over the calibration range": ("high", False),
    "below the calibration range": ("low", False),
}


def _objection(body: Column) -> Column:
    """metric, value, limit, direction of the text after a label; other wordings are the metric as they stand.

    A body reads ``metric value = number is wording``, with ``= limit`` after some wordings.
    """
    flat = F.ltrim(F.trim(F.regexp_replace(body, r"\s+", " ")), F.lit(": "))
    said = F.substring_index(flat, "value =", -1)
    metric = F.trim(F.left(flat, F.length(flat) - F.length(said) - len("value =")))
    value, rest = F.trim(F.substring_index(said, " is ", 1)), F.trim(F.substring_index(said, " is ", -1))
    wording, limit = F.trim(F.substring_index(rest, "=", 1)), F.when(rest.contains("="), F.trim(F.substring_index(rest, "=", -1)))
    plain = lambda x: F.when(F.translate(x, "+-.0123456789", "") == "", x.try_cast("double"))
    fits = [(wording == w) & (limit.isNotNull() & plain(limit).isNotNull() if limited else limit.isNull()) for w, (_, limited) in OBJECTIONS.items()]
    direction = F.coalesce(*[F.when(f, d) for f, (d, _) in zip(fits, OBJECTIONS.values())])
    known = flat.contains("value =") & said.contains(" is ") & plain(value).isNotNull() & direction.isNotNull()
    return F.struct(
        F.when(known, metric).otherwise(stripped(body)).alias("metric"), F.when(known, plain(value)).alias("value"), F.when(known, plain(limit)).alias("limit"), F.when(known, direction).alias("direction")
    )


def _finder(labels: tuple[str, ...]):
    """text -> (start, end) of the labels in it, left to right, the longest at a place: one walk through an automaton of all of them."""
    try:
        import ahocorasick
    except ImportError:
        either = re.compile("|".join(map(re.escape, sorted(labels, key=lambda x: (-len(x), x)))))
        return lambda text: [m.span() for m in either.finditer(text)]
    automaton = ahocorasick.Automaton()
    for label in labels:
        automaton.add_word(label, len(label))
    automaton.make_automaton()
    return lambda text: [(end + 1 - n, end + 1) for end, n in automaton.iter_long(text)]


@F.pandas_udf(T.ArrayType(T.StructType().add("analyte", T.StringType()).add("body", T.StringType())))
def _pieces(texts: pd.Series, labels: pd.Series) -> pd.Series:
    """What follows each label, up to the next one; texts of one batch come together mostly, so its automaton is kept."""
    finders: OrderedDict = OrderedDict()
    out = []
    for text, own in zip(texts, labels):
        key = tuple(x for x in own if x) if own is not None else ()
        if not text or not key:
            out.append([])
            continue
        if key not in finders:
            finders[key] = _finder(key)
            if len(finders) > 64:
                finders.popitem(last=False)
        found = finders[key](text)
        ends = [start for start, _ in found[1:]] + [len(text)]
        out.append([{"analyte": text[a:b], "body": text[b:end]} for (a, b), end in zip(found, ends)])
    return pd.Series(out)


def instrument_objections(rows: DataFrame, text: str, labels: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The objections of a text column, cut at the labels of the row's own batch: flag_pos, analyte, metric, value, limit, direction, objection.

    ``labels`` has ``batch`` and label; a batch's labels are the columns of one export. Labels that only another batch has are text.
    The longest label at a place wins. Batches without labels give no rows.
    """
    own = labels.groupBy(batch).agg(F.array_sort(F.collect_set("label")).alias("_own"))
    each = rows.join(own, batch).select(*rows.columns, F.posexplode(_pieces(F.col(text), F.col("_own"))).alias("flag_pos", "piece"))
    return each.select(*rows.columns, "flag_pos", "piece.analyte", _objection(F.col("piece.body")).alias("o"), stripped(F.concat("piece.analyte", "piece.body")).alias("objection")).select(*rows.columns, "flag_pos", "analyte", "o.*", "objection")


def attach_intensities(b: BatchFrames, counts: BatchFrames) -> BatchFrames:
    """Fill missing intensities (and precision and internal standards) from the batch's counts file.

    Samples pair by position where both lists of names are equal, else by names that
    the counts have once. Both sides have the same batch_id.
    """
    order = F.sort_array(F.collect_list(F.struct("row_pos", "name")))
    names = lambda s, c: s.groupBy("batch_id").agg(F.transform(order, lambda x: x["name"]).alias(c))
    same = names(b.samples, "x").join(names(counts.samples, "y"), "batch_id").select("batch_id", (F.col("x") == F.col("y")).alias("same"))
    place = F.row_number().over(W.partitionBy("batch_id").orderBy("row_pos"))
    placed = counts.samples.select("batch_id", F.col("row_pos").alias("by_place"), place.alias("place"))
    once = counts.samples.groupBy("batch_id", "name").agg(F.count("*").alias("k"), F.min("row_pos").alias("by_name")).where("k = 1")
    pair = b.samples.withColumn("place", place).join(same, "batch_id").join(once, ["batch_id", "name"], "left").join(placed, ["batch_id", "place"], "left")
    pair = pair.select("batch_id", "row_pos", F.when(F.col("same"), F.col("by_place")).otherwise(F.col("by_name")).alias("other")).where("other is not null")
    found = pair.join(counts.results.select("batch_id", F.col("row_pos").alias("other"), "label", F.col("intensity").alias("i2"), F.col("rsd_pct").alias("r2")), ["batch_id", "other"])
    results = b.results.join(found.drop("other"), ["batch_id", "row_pos", "label"], "left")
    results = results.withColumns({"intensity": F.coalesce("intensity", "i2"), "rsd_pct": F.coalesce("rsd_pct", "r2")}).select(*b.results.columns)
    istd = pair.join(counts.istd.withColumnRenamed("row_pos", "other"), ["batch_id", "other"]).select(*counts.istd.columns)
    new = istd.join(b.istd.select("batch_id", "row_pos", "istd_label"), ["batch_id", "row_pos", "istd_label"], "left_anti")
    return BatchFrames(b.batches, b.analytes, b.samples, results, b.istd.unionByName(new), b.flags)


def merged_counts(b: BatchFrames) -> DataFrame:
    """The batch view without its intensities, filled again from a copy in another order."""
    bare = BatchFrames(b.batches, b.analytes, b.samples, b.results.withColumn("intensity", F.lit(None).cast("double")), b.istd, b.flags)
    turned = BatchFrames(b.batches, b.analytes, b.samples.withColumn("row_pos", -F.col("row_pos")), b.results.withColumn("row_pos", -F.col("row_pos")), b.istd.withColumn("row_pos", -F.col("row_pos")), b.flags)
    return attach_intensities(bare, turned).results.select("batch_id", "row_pos", "label", "conc", "intensity")
