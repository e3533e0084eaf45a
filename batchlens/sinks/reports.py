"""Reports of any number of batches, written by the tasks: a JSON file and an HTML page a batch.

``report_rows(...).write.format("labreports").mode("overwrite").save(folder)``. A task's attempt writes into a folder of its own
and names that folder, with counts, in its commit message; what the driver gathers grows with the tasks, not with the batches.
The job commits by replacing one file, ``_manifest.json``, which names the folders that count, so readers see all of a job's reports or
none: attempts that were lost, ran twice or failed are in no manifest. ``overwrite`` then removes the folders of earlier manifests; ``append``
adds to them; ``abort`` leaves the old manifest as it was.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from batchlens.model import BatchFrames
from batchlens.sinks.report import as_html, assembled
from batchlens.sources.datasource import store_of

MANIFEST = "_manifest.json"
SCHEMA = (
    "batch_id string, source_path string, template_id string, instrument_family string, warnings array<string>, "
    "analytes array<struct<pos: int, role: string, label: string, mass: int, element: string, mass_shift: int, mode: string, wavelength_nm: double>>, types array<struct<type: string, n: bigint>>, "
    "checks array<struct<catalog_pos: int, check_id: string, outcome: string, reason: string, verify: string, rows: array<struct<ok: boolean, payload: string>>>>"
)


def report_rows(b: BatchFrames, results: DataFrame, details: DataFrame) -> DataFrame:
    """A row a batch with all that its report says. A batch is one run of an instrument, so its rows stay together."""
    listed = lambda *columns: F.sort_array(F.collect_list(F.struct(*columns)))
    analytes = b.analytes.groupBy("batch_id").agg(listed("pos", "role", "label", "mass", "element", "mass_shift", "mode", "wavelength_nm").alias("analytes"))
    types = b.samples.groupBy("batch_id", "type").agg(F.count("*").alias("n")).groupBy("batch_id").agg(listed("type", "n").alias("types"))
    rows = details.groupBy("batch_id", "check_id").agg(F.collect_list(F.struct("ok", "payload")).alias("rows"))
    checks = results.join(rows, ["batch_id", "check_id"], "left").groupBy("batch_id").agg(listed("catalog_pos", "check_id", "outcome", "reason", "verify", "rows").alias("checks"))
    out = b.batches.join(analytes, "batch_id", "left").join(types, "batch_id", "left").join(checks, "batch_id", "left")
    return out.select("batch_id", "source_path", "template_id", "instrument_family", "warnings", "analytes", "types", "checks")


def file_stem(batch_id: str) -> str:
    """The name of a batch's files: the end of its id, and a digest so that no two are the same."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", batch_id)[-80:] + "-" + hashlib.sha256(batch_id.encode()).hexdigest()[:12]


def _read(store: fs.FileSystem, path: str) -> dict | None:
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


def _put(store: fs.FileSystem, path: str, text: str) -> None:
    """Write a file under another name and put it in its place."""
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(text.encode())
    store.move(own, path)


@dataclass
class Written(WriterCommitMessage):
    """What an attempt wrote."""

    folder: str
    batches: int
    failed: int


class ReportWriter(DataSourceWriter):
    """Writes reports in tasks, commits by a manifest."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, f"run-{uuid.uuid4().hex[:12]}"

    def write(self, rows: Iterator[Row]) -> Written:
        store, place = store_of(self.path)
        folder, n, failed = f"{self.run}/part-{uuid.uuid4().hex[:12]}", 0, 0
        for row in rows:
            if not n:
                store.create_dir(f"{place}/{folder}", recursive=True)
            report = assembled(row.asDict(recursive=True))
            for kind, text in (("json", json.dumps(report, indent=1, ensure_ascii=False)), ("html", as_html(report))):
                with store.open_output_stream(f"{place}/{folder}/{file_stem(row['batch_id'])}.{kind}") as out:
                    out.write(text.encode())
            n, failed = n + 1, failed + (report["verdict"] == "FAIL")
        return Written(folder, n, failed)

    def commit(self, messages: list[Written | None]) -> None:
        store, place = store_of(self.path)
        store.create_dir(place, recursive=True)
        before = _read(store, f"{place}/{MANIFEST}") or {"parts": []}
        parts = [{"folder": m.folder, "batches": m.batches, "failed": m.failed} for m in messages if m and m.batches]
        kept = parts if self.overwrite else before["parts"] + parts
        head = {"written_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "batches": sum(p["batches"] for p in kept), "failed": sum(p["failed"] for p in kept), "parts": kept}
        _put(store, f"{place}/{MANIFEST}", json.dumps(head, indent=1))
        self._clear(store, place, {p["folder"] for p in kept}, {p["folder"] for p in before["parts"]})

    def _clear(self, store: fs.FileSystem, place: str, kept: set[str], before: set[str]) -> None:
        """Remove this run's other attempts, and folders of the manifest that was replaced."""
        own = store.get_file_info(fs.FileSelector(f"{place}/{self.run}", allow_not_found=True))
        for folder in ({f"{self.run}/{f.base_name}" for f in own} | before) - kept:
            if store.get_file_info(f"{place}/{folder}").type == fs.FileType.Directory:
                store.delete_dir(f"{place}/{folder}")

    def abort(self, messages: list[Written | None]) -> None:
        store, place = store_of(self.path)
        if store.get_file_info(f"{place}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{place}/{self.run}")


class LabReports(DataSource):
    """The sink of reports."""

    @classmethod
    def name(cls) -> str:
        return "labreports"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ReportWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make ``labreports`` known to a session."""
    spark.dataSource.register(LabReports)


def write_reports(b: BatchFrames, results: DataFrame, details: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Reports of all batches."""
    register(results.sparkSession)
    report_rows(b, results, details).write.format("labreports").mode(mode).save(path)


def committed(path: str) -> tuple[dict, list[str]]:
    """The manifest of a folder of reports, and the JSON files that it stands for."""
    store, place = store_of(path.rstrip("/"))
    head = _read(store, f"{place}/{MANIFEST}")
    if head is None:
        raise FileNotFoundError(f"{path} has no reports that are committed")
    files = [f.path for p in head["parts"] for f in store.get_file_info(fs.FileSelector(f"{place}/{p['folder']}")) if f.extension == "json"]
    return head, sorted(files)
