"""The driver's tables as instrument batches: a sample is an order, an analyte a line number.

A batch is the orders of a month by 1,500 neighbouring customers, so there are more batches, not larger ones, in larger tables.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.model import BatchFrames, carried_istd, carried_results, dealt, kept_by_batch

#: The view that both engines read. Names: ``sample`` S and the sequence number, CRM for some controls.
VIEW = """
with s0 as (
  select o.*, o_orderkey as sample_id, cast(row_number() over (partition by batch order by o_orderdate, o_orderkey) as int) as seq,
    case o_orderkey % 20 when 0 then 'CAL_STD' when 1 then 'CAL_STD' when 2 then 'CAL_BLANK' when 3 then 'ICV'
      when 4 then 'CCV' when 5 then 'CCV' when 6 then 'CCB' when 7 then 'MB' when 8 then 'LCS' when 9 then 'DUP'
      when 10 then 'MS' when 11 then 'MSD' when 12 then 'SERIAL_DIL' else 'SAMPLE' end as sample_type,
    cast(5 + (o_orderkey % 7)*15 as double) as lev,
    cast(300000 + (o_orderkey % 41)*10000 as double) as istd
  from (select *, concat(cast(year(o_orderdate)*100+month(o_orderdate) as varchar(8)), '-', cast(cast(floor((o_custkey - 1) / 1500) as int) as varchar(8))) as batch from orders) o),
s1 as (
  select *, case when sample_type in ('DUP','MS','MSD','SERIAL_DIL') then
    max(case when sample_type='SAMPLE' then seq end) over (partition by batch order by seq rows between unbounded preceding and 1 preceding) end as parent_seq from s0),
sm as (
  select batch as batch_id, sample_id, seq, sample_type,
    case when sample_type in ('CAL_STD','ICV','CCV','LCS') then lev when sample_type in ('MS','MSD') then cast(20 as double) end as level,
    concat('S', cast(seq as varchar(8))) as name,
    case when parent_seq is not null then concat('S', cast(parent_seq as varchar(8))) end as parent_name, parent_seq, istd
  from s1),
line as (select l_orderkey, l_linenumber, min(l_quantity) as q, min(l_discount) as d, min(l_tax) as t
         from lineitem group by l_orderkey, l_linenumber),
rs as (
  select batch_id, seq, label, case when not below_dl then conc end as conc, case when not below_dl then conc*2000*(1+(t-0.04)/2) end as intensity,
    below_dl, case when below_dl then dl end as dl, t*100 as rsd_pct
  from (select s.batch_id, s.seq, concat('L', cast(l.l_linenumber as varchar(4))) as label, l.t,
          s.sample_type in ('CAL_BLANK','CCB','MB') and l.d = 0 as below_dl, cast(0.05 as double) + l.t as dl,
          case when s.sample_type in ('CAL_BLANK','CCB','MB') then l.d*1.2
               when s.sample_type in ('CAL_STD','ICV','CCV','LCS') then s.level*(0.88+2.4*l.d)
               else l.q end as conc
        from sm s join line l on s.sample_id=l.l_orderkey) z)
"""


def _orders_and_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return orders, lines


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Samples and results of the view."""
    orders, lines = _orders_and_lines(spark, sf_dir)
    lines = lines.repartition("l_orderkey")  # once, for the groups and the join
    sql = VIEW.replace("from orders)", "from {orders})").replace("from lineitem ", "from {lineitem} ")
    samples = spark.sql(sql + "select batch_id, seq, name, sample_type, level, parent_name, istd from sm", orders=orders, lineitem=lines)
    results = spark.sql(sql + "select batch_id, seq, label, conc, intensity, below_dl, dl, rsd_pct from rs", orders=orders, lineitem=lines)
    return {"samples": samples, "results": results}


#: A sample of the view as one of the model.
_SAMPLE = [
    "batch_id", "seq as row_pos", "seq as seq_index", "name", "sample_type as type", "level", "parent_name", "cast(null as double) as dilution_factor", "cast(array() as array<string>) as flags",
]


def batch_frames(spark: SparkSession, sf_dir: str) -> BatchFrames:
    """The canonical tables of the view; L1 to L7 stand for emission lines of one element."""
    t = tables(spark, sf_dir)
    samples = t["samples"].selectExpr(*_SAMPLE)
    batches, analytes = _of_batches(t["samples"].select("batch_id").distinct())
    results = t["results"].select("batch_id", F.col("seq").alias("row_pos"), "label", "conc", F.lit("ppb").alias("unit"), "intensity", "below_dl", "dl", "rsd_pct")
    cps = t["samples"].select("batch_id", F.col("seq").alias("row_pos"), F.lit("IS").alias("istd_label"), F.col("istd").alias("cps"))
    return BatchFrames(batches, analytes, samples, results, cps, _objections(results))


def _of_batches(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batches and analytes of these ids."""
    null = lambda kind: F.lit(None).cast(kind)
    batches = ids.select("batch_id", F.lit("orders").alias("source_path"), F.lit("testbed").alias("template_id"), F.lit("testbed").alias("instrument_family"), F.lit(True).alias("flags_column_mapped"), F.array().cast("array<string>").alias("warnings"))
    labels = ids.select("batch_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("pos")).select(
        "batch_id", "pos", F.lit("analyte").alias("role"), F.concat(F.lit("L"), F.col("pos").cast("string")).alias("label"), null("int").alias("mass"), F.lit("Xx").alias("element"),
        null("int").alias("mass_shift"), null("string").alias("mode"), (F.col("pos") * 100.0).alias("wavelength_nm"),
    )
    istd = ids.select("batch_id", F.lit(8).alias("pos"), F.lit("istd").alias("role"), F.lit("IS").alias("label"), null("int").alias("mass"), null("string").alias("element"), null("int").alias("mass_shift"), null("string").alias("mode"), null("double").alias("wavelength_nm"))
    return batches, labels.unionByName(istd)


def _objections(results: DataFrame) -> DataFrame:
    """Flags on results that scatter."""
    return results.where("rsd_pct > 7").select(
        "batch_id", "row_pos", F.substring("label", 2, 4).cast("int").alias("flag_pos"), F.col("label").alias("analyte"), F.lit("CPS RSD").alias("metric"),
        F.col("rsd_pct").alias("value"), F.lit(7.0).alias("limit"), F.lit("high").alias("direction"), F.lit("over the allowed maximum").alias("text"),
    )


#: What the view makes of a line ``l`` of a sample: concentration, and whether it is below the limit.
_CONC = """case when sample_type in ('CAL_BLANK','CCB','MB') then l.d*1.2
  when sample_type in ('CAL_STD','ICV','CCV','LCS') then level*(0.88+2.4*l.d) else l.q end"""
_BELOW = "sample_type in ('CAL_BLANK','CCB','MB') and l.d = 0"
_CARRIED = f"""transform(lines, l -> named_struct('label', concat('L', cast(l.l_linenumber as string)), 'pos', case when l.l_linenumber between 1 and 7 then cast(l.l_linenumber as int) end,
  'element', 'Xx', 'wavelength_nm', cast(l.l_linenumber * 100.0 as double), 'conc', case when not ({_BELOW}) then {_CONC} end, 'unit', 'ppb',
  'intensity', case when not ({_BELOW}) then {_CONC}*2000*(1+(l.t-0.04)/2) end, 'below_dl', {_BELOW}, 'dl', case when {_BELOW} then cast(0.05 as double) + l.t end, 'rsd_pct', l.t*100)) as results"""


def carrying_frames(spark: SparkSession, sf_dir: str) -> BatchFrames:
    """The tables of ``batch_frames`` with samples that carry their results, kept by batch (``BatchFrames.carrying``).

    The lines are moved twice: to their order, and with it to its batch.
    """
    orders, lines = _orders_and_lines(spark, sf_dir)
    lines = dealt(lines, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_discount").alias("d"), F.min("l_tax").alias("t"))
    lines = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "q", "d", "t")).alias("lines"))
    orders = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    inner = VIEW[VIEW.index("(select *, concat(") : VIEW.index(" o),\ns1")]  # the orders with their batch
    orders = dealt(spark.sql(inner[1:-1].replace("from orders", "from {orders}"), orders=orders), "batch")
    sql = VIEW[: VIEW.index(",\nline as (")].replace(inner, "{orders}").replace("parent_seq, istd\n", "parent_seq, istd, lines\n")
    t = spark.sql(sql + " select * from sm", orders=orders)
    samples = t.selectExpr(*_SAMPLE, _CARRIED, "array(named_struct('istd_label', 'IS', 'cps', istd)) as cps").withColumn("flagged", F.exists("results", lambda r: r["rsd_pct"] > 7))
    samples = kept_by_batch(samples)
    batches, analytes = _of_batches(samples.select("batch_id").distinct())
    results = carried_results(samples)
    return BatchFrames(batches, analytes, samples, results, carried_istd(samples), _objections(results))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a session on one machine that names none gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="batchlens-")
    return f"{folder.rstrip('/')}/exports-{uuid.uuid4().hex[:12]}"


# How exports write the types of samples.
_WRITTEN = {"CAL_STD": "CalStd", "CAL_BLANK": "CalBlk", "SAMPLE": "Sample", "DUP": "Dup"}


def exports(spark: SparkSession, sf_dir: str) -> str:
    """Write every batch of the view as a wide export, a file each, and return the folder: batch_id=.../part-*.txt."""
    t = tables(spark, sf_dir)
    labels = [f"L{i}" for i in range(1, 8)]
    cell = F.when(F.col("below_dl"), F.concat(F.lit("<"), F.col("dl").cast("string"))).otherwise(F.col("conc").cast("string"))
    of = lambda label, value: F.coalesce(F.max(F.when(F.col("label") == label, value)), F.lit(""))
    kind = F.coalesce(*[F.when(F.col("sample_type") == k, v) for k, v in _WRITTEN.items()], "sample_type")
    head = ",".join(["Seq", "Sample Name", "Type", "Level [ppb]", *(f"{x} Conc. [ppb]" for x in labels), *(f"{x} CPS" for x in labels)])
    first = F.struct("seq", F.concat_ws(",", F.col("seq").cast("string"), "name", kind, F.coalesce(F.col("level").cast("string"), F.lit(""))).alias("first"))
    firsts = F.inline(F.when(F.col("seq") == 1, F.array(F.struct(F.lit(0).alias("seq"), F.lit(head).alias("first")), first)).otherwise(F.array(first)))
    samples = t["samples"].select("batch_id", firsts)
    results = t["results"].select("batch_id", "seq", "label", cell.alias("cell"), F.col("intensity").cast("string").alias("intensity"))
    rows = samples.unionByName(results, allowMissingColumns=True).repartition("batch_id").groupBy("batch_id", "seq")
    line = F.concat_ws(",", F.max("first"), *(of(x, F.col("cell")) for x in labels), *(of(x, F.col("intensity")) for x in labels))
    lines = rows.agg(F.when(F.col("seq") == 0, F.max("first")).otherwise(line).alias("value"))
    path = shared_folder(spark)
    lines.sortWithinPartitions("batch_id", "seq").select("batch_id", "value").write.partitionBy("batch_id").text(path)
    return path
