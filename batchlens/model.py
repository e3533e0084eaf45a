"""The canonical tables of instrument batches: one row a sample, and one a sample and analyte.

Every table carries ``batch_id``, so one plan reviews any number of batches. Order
within a batch is ``row_pos`` (the sequence), of analytes ``pos``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The sample types of the canonical model.
SAMPLE_TYPES = ("CAL_STD", "CAL_BLANK", "ICV", "CCV", "ICB", "CCB", "MB", "LCS", "SAMPLE", "DUP", "MS", "MSD", "SERIAL_DIL", "POST_SPIKE", "OTHER")
#: The types that count between two continuing verifications.
ANALYSIS_TYPES = ("MB", "LCS", "SAMPLE", "DUP", "MS", "MSD", "SERIAL_DIL", "POST_SPIKE")

BATCHES = "batch_id string, source_path string, template_id string, instrument_family string, flags_column_mapped boolean, warnings array<string>"
ANALYTES = "batch_id string, pos int, role string, label string, mass int, element string, mass_shift int, mode string, wavelength_nm double"
SAMPLES = "batch_id string, row_pos int, seq_index int, name string, type string, level double, parent_name string, dilution_factor double, flags array<string>"
RESULTS = "batch_id string, row_pos int, label string, conc double, unit string, intensity double, below_dl boolean, dl double, rsd_pct double"
ISTD = "batch_id string, row_pos int, istd_label string, cps double"
FLAGS = "batch_id string, row_pos int, flag_pos int, analyte string, metric string, value double, limit double, direction string, text string"


#: The fields of a result that its sample carries.
CARRIED = ("label", "pos", "element", "wavelength_nm", "conc", "unit", "intensity", "below_dl", "dl", "rsd_pct")


def carried_results(samples: DataFrame) -> DataFrame:
    """The table of results of samples that carry them."""
    return samples.select("batch_id", "row_pos", F.inline("results")).select("batch_id", "row_pos", "label", "conc", "unit", "intensity", "below_dl", "dl", "rsd_pct")


def carried_istd(samples: DataFrame) -> DataFrame:
    """The table of internal standards of samples that carry them."""
    return samples.select("batch_id", "row_pos", F.inline("cps"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows with a short plan: as Parquet in the folder that the session names for checkpoints; without one they are kept by Spark.

    Readers make long plans, and each check would plan and compute them again. Parquet keeps a column that
    repeats (paths, batches, labels) in a small part of the space that a checkpoint's rows take.
    """
    spark = df.sparkSession
    if not (folder := spark.sparkContext.getCheckpointDir()):
        return df.persist()
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, column: str = "batch_id") -> DataFrame:
    """The same rows, dealt out by a key to as many tasks as shuffles have: a number of its own, so that Spark doesn't merge small ones into tasks of much memory."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)


def kept_by_batch(df: DataFrame) -> DataFrame:
    """Rows that ``dealt`` gave, each batch in one bucket of a table in the folder for checkpoints; without one Spark keeps them.

    Windows, groups and joins of a batch then move no rows. The table's name is given up again, its files stay like those of ``cut``.
    """
    spark = df.sparkSession
    if not (folder := spark.sparkContext.getCheckpointDir()):
        return df.persist()
    name, n = f"batches_{uuid.uuid4().hex[:12]}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{folder.rstrip('/')}/{name}")
    writer.bucketBy(n, "batch_id").sortBy("batch_id", "row_pos").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")
    return out


def carries(samples: DataFrame) -> bool:
    """Whether the samples carry their results (``BatchFrames.carrying``)."""
    return "results" in samples.columns


@dataclass(frozen=True)
class BatchFrames:
    """The tables of one or more batches."""

    batches: DataFrame
    analytes: DataFrame
    samples: DataFrame
    results: DataFrame
    istd: DataFrame
    flags: DataFrame

    def of_type(self, *types: str) -> DataFrame:
        """Samples of these types."""
        return self.samples.where(self.samples["type"].isin(*types))

    def cached(self) -> BatchFrames:
        """The same tables, computed once for a run of several checks.

        These are checkpoints, not Parquet: by its small files Spark would take tables that grow for ones to broadcast.
        """
        return self._kept(*(f.name for f in fields(self)))

    def _kept(self, *names: str) -> BatchFrames:
        keep = "checkpoint" if self.batches.sparkSession.sparkContext.getCheckpointDir() else "persist"
        return replace(self, **{n: getattr(getattr(self, n), keep)() for n in names})

    def carrying(self) -> BatchFrames:
        """The same tables for the outcomes of many checks: each sample carries its results, and all are kept by batch.

        Samples have three columns more: ``results`` (with the analyte's place, element and wavelength; place null where the batch has
        no such analyte), ``cps`` of internal standards, and ``flagged``. The results are moved once for all checks, not by each.
        """
        b, key = self._kept("batches", "analytes", "flags"), ["batch_id", "row_pos"]
        lines = b.analytes.where("role = 'analyte'").select("batch_id", "pos", "label", "element", "wavelength_nm")
        results = self.results.join(lines, ["batch_id", "label"], "left").groupBy(*key).agg(F.collect_list(F.struct(*CARRIED)).alias("results"))
        cps = self.istd.groupBy(*key).agg(F.collect_list(F.struct("istd_label", "cps")).alias("cps"))
        flagged = b.flags.select(*key, F.lit(True).alias("flagged")).distinct()
        samples = kept_by_batch(dealt(self.samples.join(results, key, "left").join(cps, key, "left").join(flagged, key, "left")))
        return replace(b, samples=samples, results=carried_results(samples), istd=carried_istd(samples))

    def union(self, other: BatchFrames) -> BatchFrames:
        """Both sets of batches."""
        return BatchFrames(**{f.name: getattr(self, f.name).unionByName(getattr(other, f.name)) for f in fields(self)})


def frames(spark: SparkSession, batches=(), analytes=(), samples=(), results=(), istd=(), flags=()) -> BatchFrames:
    """Tables from rows in memory, for small inputs and tests."""
    rows = (batches, analytes, samples, results, istd, flags)
    return BatchFrames(*(spark.createDataFrame(list(r), s) for r, s in zip(rows, (BATCHES, ANALYTES, SAMPLES, RESULTS, ISTD, FLAGS))))
