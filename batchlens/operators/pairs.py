"""Checks that compare results with one another: parents, lines, precision, internal standards, recomputed quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from batchlens.functions.stats import count_if, first_by, pearson
from batchlens.model import SAMPLE_TYPES, BatchFrames, carries
from batchlens.operators.base import KEY, Check, analytes, blocked_below, every_result, loq, rpd, unblocked, window

_ROW = ["batch_id", "row_pos", "name", "label"]


def assessed(params: dict) -> Column:
    """Whether a result has a deviation and enough signal for it to be judged."""
    cps, mult = params.get("min_intensity_cps"), params.get("min_conc_x_loq", 10)
    by_conc = F.when(F.col("conc").isNotNull(), F.col("conc") > loq(params, F.col("label")) * mult).otherwise(F.col("intensity").isNotNull())
    enough = F.when(F.col("intensity").isNotNull(), F.col("intensity") >= cps).otherwise(by_conc) if cps is not None else by_conc
    return F.col("rsd_pct").isNotNull() & enough


def precisions(b: BatchFrames, params: dict) -> DataFrame:
    """Relative standard deviations of results with enough signal, per analyte of every batch, those without any %RSD too."""
    most = float(params.get("max_rsd_pct", 5.0))
    types = params.get("types")
    if types and (bad := [t for t in types if t not in SAMPLE_TYPES]):
        raise ValueError(f"unknown sample types: {bad}")
    rows = every_result(b, b.of_type(*types) if types else b.samples)
    rows = rows.withColumn("assessed", assessed(params))
    used = F.when(F.col("assessed"), F.col("rsd_pct"))
    out = rows.groupBy("batch_id", "label").agg(
        count_if(F.col("assessed")).alias("n_assessed"), count_if(used > most).alias("n_over"), F.max(used).alias("max_rsd_pct"),
        first_by(F.when(F.col("assessed"), F.col("name")), F.coalesce(used, F.lit(-1.0)), F.col("row_pos")).alias("worst_sample"),
    )
    return out.withColumn("ok", F.when(F.col("n_assessed") > 0, F.col("n_over") == 0)).withColumn("worst_sample", F.when(F.col("n_over") > 0, F.col("worst_sample")))


def precision_rsd(b: BatchFrames, params: dict) -> Check:
    """Relative standard deviations of results with enough signal, per analyte."""
    some = b.results.where("rsd_pct is not null").select("batch_id").distinct()
    blocked = b.batches.select("batch_id").join(some, "batch_id", "left_anti").withColumn("reason", F.lit("no %RSD columns in this export"))
    return Check(unblocked(precisions(b, params), blocked), blocked, undecided="no result has enough signal to judge its precision")


def instrument_flags(b: BatchFrames, params: dict) -> Check:
    """The instrument's own objections: a summary row a batch, and the first rows of them."""
    limit, outcome = params.get("max_rows", 60), "FAIL" if params.get("on_flag", "warn") == "fail" else "WARN"
    kinds = b.flags.groupBy("batch_id", "metric").count().groupBy("batch_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat(F.col("count").cast("string"), F.lit(" x "), "metric"))), ", ").alias("kinds"), F.sum("count").alias("total")
    )
    marked = b.samples if carries(b.samples) else b.samples.join(b.flags.select(*KEY).distinct().withColumn("flagged", F.lit(True)), [*KEY], "left")
    marked = marked.where("flagged or size(flags) > 0").groupBy("batch_id").agg(F.count("*").alias("samples_flagged"))
    head = marked.join(kinds, "batch_id", "left").select(
        "batch_id", F.lit(0).alias("ord"), F.lit(None).cast("int").alias("row_pos"), F.lit(None).cast("string").alias("analyte"), F.col("kinds").alias("metric"),
        F.coalesce("total", F.lit(0)).alias("n"), "samples_flagged", F.lit(None if outcome == "WARN" else False).cast("boolean").alias("ok"),
    )
    order = W.partitionBy("batch_id").orderBy("row_pos", "flag_pos")
    each = b.flags.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= limit)
    each = each.select("batch_id", "ord", "row_pos", "analyte", "metric", F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("samples_flagged"), F.lit(None).cast("boolean").alias("ok"))
    rest = kinds.where(F.col("total") > limit).select(
        "batch_id", F.lit(limit + 1).alias("ord"), F.lit(None).cast("int").alias("row_pos"), F.lit(None).cast("string").alias("analyte"), F.lit("more").alias("metric"),
        (F.col("total") - limit).alias("n"), F.lit(None).cast("long").alias("samples_flagged"), F.lit(None).cast("boolean").alias("ok"),
    )
    blocked = b.batches.where("not coalesce(flags_column_mapped, false)").select("batch_id", F.lit("the template maps no instrument-flag column").alias("reason"))
    clean = b.batches.join(marked.select("batch_id"), "batch_id", "left_anti").select("batch_id", F.lit("PASS").alias("outcome"), F.lit("the instrument raised no objection").alias("reason"))
    said = marked.select("batch_id", F.lit(outcome).alias("outcome"), F.concat(F.col("samples_flagged").cast("string"), F.lit(" sample(s) with objections")).alias("reason"))
    return Check(unblocked(head.unionByName(each).unionByName(rest), blocked), blocked, said.unionByName(clean))


def istd_recovery(b: BatchFrames, params: dict) -> Check:
    """Internal standards against their mean over the calibration: a summary row each, then rows that fail."""
    lo, hi = window(params, default=(70, 130))
    typed = b.samples.select(*KEY, "name", "type", F.inline("cps")) if carries(b.samples) else b.istd.join(b.samples.select(*KEY, "name", "type"), [*KEY])
    cal = F.col("type").isin("CAL_STD", "CAL_BLANK")
    ref = typed.where(cal).groupBy("batch_id", "istd_label").agg(F.avg("cps").alias("reference"))
    by = W.partitionBy("batch_id", "istd_label")
    rows = typed.withColumns({"reference": F.avg(F.when(cal, F.col("cps"))).over(by), "n_cal": count_if(cal).over(by)}).where(~cal & F.col("cps").isNotNull() & (F.col("n_cal") > 0))
    rows = rows.withColumn("recovery_pct", F.try_divide(F.col("cps") * 100, F.col("reference")))
    rows = rows.withColumn("ok", F.col("recovery_pct").between(lo, hi))
    total = rows.groupBy("batch_id", "istd_label").agg(F.count("*").alias("n"), F.min("recovery_pct").alias("min_pct"), F.max("recovery_pct").alias("max_pct"), F.bool_and("ok").alias("ok"))
    total = ref.where("reference is not null").select("batch_id", "istd_label").join(total, ["batch_id", "istd_label"], "left")
    total = total.select("batch_id", "istd_label", F.lit(None).cast("int").alias("row_pos"), F.coalesce("n", F.lit(0)).alias("n"), "min_pct", "max_pct", "ok")
    bad = rows.where("not ok").select("batch_id", "istd_label", "row_pos", F.lit(1).cast("long").alias("n"), F.col("recovery_pct").alias("min_pct"), F.col("recovery_pct").alias("max_pct"), "ok")
    columns = b.analytes.where("role = 'istd'").select("batch_id").union(b.istd.select("batch_id")).distinct()
    none = b.batches.select("batch_id").join(columns, "batch_id", "left_anti").withColumn("reason", F.lit("no ISTD columns in export"))
    usable = ref.where("reference is not null").groupBy("batch_id").agg(F.bool_or(F.col("reference") == 0).alias("zero"))
    empty = columns.join(usable, "batch_id", "left_anti").withColumn("reason", F.lit("no ISTD intensities found in calibration block"))
    zero = usable.where("zero").select("batch_id", F.lit("check error: an ISTD reference is 0").alias("reason"))
    blocked = none.unionByName(empty).unionByName(zero)
    return Check(unblocked(total.unionByName(bad), blocked), blocked)


def parents(b: BatchFrames) -> DataFrame:
    """The first sample of each name among samples proper: batch_id, parent_name, parent_pos."""
    return b.of_type("SAMPLE").groupBy("batch_id", "name").agg(F.min("row_pos").alias("parent_pos")).withColumnRenamed("name", "parent_name")


def _conc_of(results: str) -> Column:
    """The concentration that an array of results has for the row's label."""
    return F.get(F.filter(results, lambda r: r["label"] == F.col("label")), F.lit(0))["conc"]


def with_parent(b: BatchFrames, *types: str) -> DataFrame:
    """Results of samples of these types with ``parent_conc`` and ``parent_pos`` (null where there is no such parent)."""
    if carries(b.samples):
        proper = F.col("type") == "SAMPLE"
        of = W.partitionBy("batch_id", F.when(proper, F.col("name")).otherwise(F.col("parent_name")))
        first = F.min_by(F.struct("row_pos", "results"), F.when(proper, F.col("row_pos"))).over(of)
        samples = b.of_type("SAMPLE", *types).withColumn("parent", first).where(F.col("type").isin(*types))
        parent = F.when(F.col("parent_name").isNotNull(), F.col("parent"))
        rows = every_result(b, samples.withColumns({"parent_pos": parent["row_pos"], "of_parent": parent["results"]}).drop("parent"))
        return rows.withColumn("parent_conc", _conc_of("of_parent")).drop("of_parent")
    rows = every_result(b, b.of_type(*types).join(parents(b), ["batch_id", "parent_name"], "left"))
    of = b.results.select("batch_id", F.col("row_pos").alias("parent_pos"), "label", F.col("conc").alias("parent_conc"))
    return rows.join(of, ["batch_id", "parent_pos", "label"], "left")


def dup_rpd(b: BatchFrames, params: dict) -> Check:
    """Relative percent difference of duplicates above a multiple of the LOQ."""
    most, mult = params.get("max_rpd_pct", 20), params.get("min_conc_x_loq", 5)
    rows = with_parent(b, "DUP").where("parent_pos is null or (conc is not null and parent_conc is not null)")
    low = F.least("conc", "parent_conc") <= loq(params, F.col("label")) * mult
    value = F.when(F.col("parent_pos").isNotNull() & ~low, rpd(F.col("parent_conc"), F.col("conc")))
    out = rows.select(*_ROW, "parent_name", "conc", "parent_conc", value.alias("rpd_pct")).withColumn("ok", F.col("rpd_pct") <= most)
    return Check(out, blocked_below(b, b.of_type("DUP"), 1, "no duplicate samples in batch"), undecided="no duplicate pair is above the limit for judging")


def ms_msd(b: BatchFrames, params: dict) -> Check:
    """Recovery of matrix spikes, and the difference between spike and spike duplicate of one parent."""
    (lo, hi), most = window(params, default=(75, 125)), params.get("max_rpd_pct", 20)
    spikes = b.of_type("MS", "MSD")
    rows = with_parent(b, "MS", "MSD")
    known = F.col("parent_pos").isNotNull() & (F.coalesce("level", F.lit(0.0)) != 0)
    pct = F.when(known, (F.col("conc") - F.col("parent_conc")) / F.nullif(F.col("level"), F.lit(0.0)) * 100)
    rec = rows.where(~known | (F.col("conc").isNotNull() & F.col("parent_conc").isNotNull())).select(*_ROW, F.lit("recovery").alias("kind"), pct.alias("value_pct")).withColumn("ok", F.col("value_pct").between(lo, hi))
    if carries(spikes):
        last = lambda t: F.max_by(F.struct("name", "row_pos", "results"), F.when(F.col("type") == t, F.col("row_pos"))).alias(t)
        one = spikes.where("parent_name is not null").groupBy("batch_id", "parent_name").agg(last("MS"), last("MSD")).where("MS is not null and MSD is not null")
        both = every_result(b, one.select("batch_id", "MS.*", F.col("MSD.results").alias("others"))).withColumn("other", _conc_of("others"))
    else:
        last = W.partitionBy("batch_id", "parent_name", "type").orderBy(F.desc("row_pos"))
        one = spikes.where("parent_name is not null").withColumn("i", F.row_number().over(last)).where("i = 1")
        values = b.results.select(*KEY, "label", "conc")
        ms, msd = (one.where(F.col("type") == t).select("batch_id", "parent_name", "name", "row_pos").join(values, [*KEY]) for t in ("MS", "MSD"))
        both = ms.join(msd.select("batch_id", "parent_name", "label", F.col("conc").alias("other")), ["batch_id", "parent_name", "label"])
        both = both.join(analytes(b).select("batch_id", "label"), ["batch_id", "label"])
    pair = both.where("conc is not null and other is not null").select(*_ROW, F.lit("rpd").alias("kind"), rpd(F.col("conc"), F.col("other")).alias("value_pct"), (F.col("conc") + F.col("other") == 0).alias("zero"))
    zero = pair.where("zero").select("batch_id").distinct().withColumn("reason", F.lit("check error: the mean of a spike pair is 0"))
    pair = pair.drop("zero").withColumn("ok", F.col("value_pct") <= most)
    blocked = blocked_below(b, spikes, 1, "no MS/MSD samples in batch").unionByName(zero)
    return Check(unblocked(rec.unionByName(pair), blocked), blocked)


def serial_dilution(b: BatchFrames, params: dict) -> Check:
    """A diluted sample, times its factor, agrees with its parent."""
    factor, most, mult = params.get("factor", 5), params.get("agreement_pct", 10), params.get("min_conc_x_loq", 50)
    rows = with_parent(b, "SERIAL_DIL").where("parent_pos is null or (conc is not null and parent_conc is not null)")
    expected = F.col("parent_conc") / factor
    gated = F.col("parent_conc") <= loq(params, F.col("label")) * mult
    diff = F.when(F.col("parent_pos").isNotNull() & ~gated, F.try_divide(F.abs(F.col("conc") - expected), expected) * 100)
    out = rows.select(*_ROW, "parent_name", "conc", "parent_conc", diff.alias("diff_pct")).withColumn("ok", F.col("diff_pct") <= most)
    return Check(out, blocked_below(b, b.of_type("SERIAL_DIL"), 1, "no serial dilution samples in batch"), undecided="no parent is high enough to judge its dilution")


def oes_line_agreement(b: BatchFrames, params: dict) -> Check:
    """Emission lines of one element agree; a one-sided difference names the high line."""
    most, mult, one_sided = params.get("max_relative_diff", 0.25), params.get("min_conc_x_loq", 10), params.get("systematic_share", 0.8)
    lines = b.analytes.where("role = 'analyte' and element is not null and wavelength_nm is not null").select("batch_id", "pos", "label", "element")
    if carries(b.samples):
        used = F.filter("results", lambda r: r["pos"].isNotNull() & r["element"].isNotNull() & r["wavelength_nm"].isNotNull() & r["conc"].isNotNull())
        side = lambda s: F.transform("used", lambda r: F.struct(r["element"].alias(f"element_{s}"), r["pos"].alias(f"pos_{s}"), r["label"].alias(f"label_{s}"), r["conc"].alias(s)))
        rows = b.samples.select("batch_id", used.alias("used")).where("size(used) > 1").select("batch_id", side("x").alias("of_x"), side("y").alias("of_y"))
        rows = rows.select("batch_id", "of_y", F.inline("of_x")).select("batch_id", "element_x", "pos_x", "label_x", "x", F.inline("of_y"))
        rows = rows.where("element_x = element_y and pos_x < pos_y").withColumnRenamed("element_x", "element")
    else:
        x, y = (lines.select("batch_id", "element", *(F.col(c).alias(f"{c}_{s}") for c in ("pos", "label"))) for s in "xy")
        pair = x.join(y, ["batch_id", "element"]).where("pos_x < pos_y")
        rx, ry = (b.results.select(*KEY, F.col("label").alias(f"label_{s}"), F.col("conc").alias(s)) for s in "xy")
        rows = pair.join(rx, ["batch_id", "label_x"]).join(ry, [*KEY, "label_y"]).where("x is not null and y is not null")
    rows = rows.withColumn("high", F.greatest(F.abs("x"), F.abs("y"))).where(F.col("high") > loq(params, F.col("label_x")) * mult)
    rows = rows.withColumn("diff", F.try_divide(F.abs(F.col("x") - F.col("y")), F.col("high")))
    out = rows.groupBy("batch_id", "element", "label_x", "label_y").agg(F.count("*").alias("n"), F.max("diff").alias("worst"), count_if(F.col("x") > F.col("y")).alias("higher")).where("n >= 2")
    share = F.greatest(F.col("higher"), F.col("n") - F.col("higher")) / F.col("n")
    named = F.when(F.col("higher") * 2 >= F.col("n"), F.col("label_x")).otherwise(F.col("label_y"))
    out = out.withColumn("ok", F.col("worst") <= most).withColumn("high_line", F.when(~F.col("ok") & (share >= one_sided), named))
    several = lines.groupBy("batch_id", "element").agg((F.min("pos") < F.max("pos")).alias("pair")).where("pair").select("batch_id").distinct()
    blocked = b.batches.select("batch_id").join(several, "batch_id", "left_anti").withColumn("reason", F.lit("no element is measured on more than one emission line"))
    return Check(out, blocked, undecided="no pair of lines has two results to compare")


def quant_crosscheck(b: BatchFrames, params: dict) -> Check:
    """Concentrations recomputed from intensities by a refitted calibration, against those reported.

    A uniform ratio is a scale factor; when enough analytes share one, the batch fails.
    """
    tol, least, mult = params.get("max_deviation_pct", 15), params.get("min_levels", 3), params.get("min_conc_x_loq", 10)
    uniform, min_r = params.get("uniform_ratio_cv_pct", 5), params.get("min_cal_r", 0.95)
    low, shared = params.get("low_cal_fraction", 1.0), params.get("min_shared_analytes", 3)
    single = b.analytes.where("role = 'istd'").groupBy("batch_id").agg(F.count("*").alias("k"), F.min("label").alias("istd_label")).where("k = 1")
    samples = b.samples.join(single.select("batch_id", "istd_label", F.lit(True).alias("ratioed")), "batch_id", "left")
    if carries(samples):
        samples = samples.withColumn("istd_cps", F.get(F.filter("cps", lambda c: c["istd_label"] == F.col("istd_label")), F.lit(0))["cps"])
    else:
        samples = samples.join(single.join(b.istd, ["batch_id", "istd_label"]).select(*KEY, F.col("cps").alias("istd_cps")), [*KEY], "left")
    rows = every_result(b, samples).withColumn("response", F.when(F.col("ratioed"), F.try_divide(F.col("intensity"), F.col("istd_cps"))).otherwise(F.col("intensity")))
    level = F.when(F.col("type") == "CAL_STD", F.col("level")).when(F.col("type") == "CAL_BLANK", F.coalesce("level", F.lit(0.0)))
    rows = rows.withColumn("x", level)
    cal = rows.where("x is not null and response is not null").groupBy("batch_id", "label").agg(
        F.count("*").alias("points"), pearson(F.col("response"), F.col("x")).alias("r"), F.regr_slope("response", "x").alias("slope"), F.regr_intercept("response", "x").alias("intercept"),
        (F.min(F.when(F.col("x") > 0, F.col("x"))) * low).alias("lo_cal"), F.max("x").alias("hi_cal"),
    ).where(F.col("points") >= least)
    fits = (F.col("r") >= min_r) & F.col("slope").isNotNull() & (F.col("slope") != 0)
    by = W.partitionBy("batch_id", "label")
    used = rows.where("response is not null and (x is not null or conc is not null)").withColumns({
        "points": F.count("x").over(by), "r": pearson(F.col("response"), F.col("x"), by), "slope": F.regr_slope("response", "x").over(by), "intercept": F.regr_intercept("response", "x").over(by),
        "lo_cal": F.min(F.when(F.col("x") > 0, F.col("x"))).over(by) * low, "hi_cal": F.max("x").over(by),
    }).where((F.col("points") >= least) & fits & F.expr("type not in ('CAL_STD', 'CAL_BLANK') and conc is not null"))
    used = used.where(F.col("conc").between(F.col("lo_cal"), F.col("hi_cal")) & (F.col("conc") > loq(params, F.col("label")) * mult))
    used = used.withColumn("predicted", F.try_divide(F.col("response") - F.col("intercept"), F.col("slope"))).where("predicted > 0")
    ratio = F.try_divide(F.col("predicted"), F.col("conc"))
    g = used.groupBy("batch_id", "label").agg(
        F.count("*").alias("n"), F.median(ratio).alias("median_ratio"), F.avg(ratio).alias("mean_ratio"), F.stddev_samp(ratio).alias("sd_ratio"),
        F.max(F.try_divide(F.abs(F.col("predicted") - F.col("conc")), F.col("conc")) * 100).alias("worst_pct"),
    ).where("n >= 2")
    cv = F.when(F.col("mean_ratio") == 0, F.lit(999.0)).otherwise(F.col("sd_ratio") / F.abs("mean_ratio") * 100)
    scaled = (cv <= uniform) & (F.abs(F.col("median_ratio") - 1) * 100 > tol)
    g = g.withColumns({"cv_pct": cv, "scale_factor": F.when(scaled, F.round("median_ratio", 4))})
    rows = g.withColumn("f", F.sort_array(F.collect_list("scale_factor").over(W.partitionBy("batch_id"))))
    rows = rows.withColumn("mid", F.get("f", F.floor(F.size("f") / 2).cast("int")))
    close = lambda v: F.try_divide(F.abs(v - F.col("mid")), F.col("mid")) * 100 <= uniform
    rows = rows.withColumns({"n_scaled": F.size("f"), "agree": F.size(F.filter("f", close))})
    rows = rows.withColumn("consensus", (F.col("n_scaled") >= shared) & (F.col("agree") >= shared) & (F.abs(F.col("mid") - 1) * 100 > tol))
    middle = rows.where("mid is not null").groupBy("batch_id").agg(F.first("mid").alias("mid"), F.first("agree").alias("agree"), F.first("consensus").alias("consensus"))
    ok = F.when(F.col("scale_factor").isNotNull(), F.when(F.col("consensus") & close(F.col("scale_factor")), F.lit(False))).when(F.col("worst_pct") > tol, F.lit(None)).otherwise(F.lit(True)).cast("boolean")
    out = rows.select("batch_id", "label", "n", "median_ratio", "cv_pct", "worst_pct", "scale_factor", ok.alias("ok"))
    weak = cal.where(~F.coalesce(fits, F.lit(False))).select(
        "batch_id", "label", F.lit(0).cast("long").alias("n"), *(F.lit(None).cast("double").alias(c) for c in ("median_ratio", "cv_pct", "worst_pct", "scale_factor")), F.lit(None).cast("boolean").alias("ok")
    )
    points = b.of_type("CAL_STD").where("level is not null").unionByName(b.of_type("CAL_BLANK"))
    few = blocked_below(b, points, least, f"need >={least} calibration points with levels, found {{n}}")
    raw = b.results.where("intensity is not null").select("batch_id").distinct()
    bare = b.batches.select("batch_id").join(raw, "batch_id", "left_anti").join(few, "batch_id", "left_anti").withColumn("reason", F.lit("export carries no raw intensities to recompute from"))
    blocked = few.unionByName(bare)
    verdict = middle.select(
        "batch_id", F.when(F.col("consensus"), F.lit("FAIL")).otherwise(F.lit("WARN")).alias("outcome"),
        F.when(F.col("consensus"), F.concat(F.col("agree").cast("string"), F.lit(" analytes share a scale factor near "), F.format_number("mid", 4))).otherwise(F.lit("a uniform offset on one analyte only")).alias("reason"),
    )
    return Check(unblocked(out.unionByName(weak), blocked), blocked, verdict, "no analyte has two results in the calibrated range")


def seq_structure(b: BatchFrames, params: dict) -> Check:
    """Sample types that a batch must have."""
    need = list(params.get("require", []))
    if not need:
        return Check(b.batches.select("batch_id", F.lit("").alias("required"), F.lit(True).alias("ok")).limit(0), b.batches.select("batch_id", F.lit("no required types configured in rule pack").alias("reason")))
    types = b.batches.select("batch_id", F.explode(F.array(*map(F.lit, need))).alias("required"))
    there = b.samples.select("batch_id", F.col("type").alias("required")).distinct().withColumn("present", F.lit(True))
    out = types.join(there, ["batch_id", "required"], "left").select("batch_id", "required", F.coalesce("present", F.lit(False)).alias("ok"))
    return Check(out, b.batches.select("batch_id", F.lit("").alias("reason")).limit(0))
