"""Command line: ``check`` an export, or all exports of a ``folder``, ``inspect`` a layout, ``validate`` a template against an export, ``accept`` it.

There is no prefilled link for reporting a problem: nothing of an export leaves the machine.
"""

from __future__ import annotations

import argparse
import json
import sys
import tempfile

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> int:
    """0 passed, 2 failed, 1 couldn't be read."""
    parser = argparse.ArgumentParser(prog="batchlens")
    commands = parser.add_subparsers(dest="command", required=True)
    check = commands.add_parser("check")
    check.add_argument("export")
    check.add_argument("--rules", default="epa6020b")
    check.add_argument("--template")
    check.add_argument("--counts")
    check.add_argument("--out", default="out")
    folder = commands.add_parser("folder")
    folder.add_argument("folder")
    folder.add_argument("--rules", default="epa6020b")
    folder.add_argument("--out", default="out")
    look = commands.add_parser("inspect")
    look.add_argument("export")
    look.add_argument("--include-names", action="store_true")
    valid = commands.add_parser("validate")
    valid.add_argument("template")
    valid.add_argument("export")
    accept = commands.add_parser("accept")
    accept.add_argument("template")
    accept.add_argument("export")
    accept.add_argument("--id", required=True)
    accept.add_argument("--folder", default="configs")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("batchlens").config("spark.ui.enabled", "false").getOrCreate()
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="batchlens-"))
    try:
        return {"check": _check, "folder": _folder, "inspect": _inspect, "validate": _validate, "accept": _accept}[a.command](spark, a)
    except (OSError, ValueError, RuntimeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


def _check(spark: SparkSession, a: argparse.Namespace) -> int:
    from batchlens.plans.engine import run
    from batchlens.sinks.report import batch_report, write_report
    from batchlens.sources.detect import read_batch

    b = read_batch(spark, a.export, a.template, a.counts).frames.cached()
    results, details = run(b, a.rules, settle=True)
    report = batch_report(b, results, details, b.batches.first()["batch_id"])
    for c in report["checks"]:
        print(f"{c['outcome']:14} {c['check_id']:24} {c['reason']}")
    print(report["verdict"], *write_report(report, a.out))
    return 2 if report["verdict"] == "FAIL" else 0


def _folder(spark: SparkSession, a: argparse.Namespace) -> int:
    from batchlens.plans.engine import run
    from batchlens.sinks.reports import committed, write_reports
    from batchlens.sources.folder import read_folder

    found = read_folder(spark, a.folder)
    b = found.frames.cached()
    write_reports(b, *run(b, a.rules), a.out)
    for r in found.files.groupBy("reader").count().orderBy("reader").collect():
        print(f"{r['count']:6} {r['reader'] or 'read by no layout'}")
    head, _ = committed(a.out)
    print(f"{head['batches']} batches, {head['failed']} failed; reports in {a.out}")
    return 2 if head["failed"] else 0 if head["batches"] else 1


def _inspect(spark: SparkSession, a: argparse.Namespace) -> int:
    from batchlens.sources.cells import read_cells
    from batchlens.sources.detect import delimiter_of
    from batchlens.sources.profile import fingerprint

    print(json.dumps(fingerprint(read_cells(spark, a.export, delimiter=delimiter_of(a.export)), a.include_names), indent=2, ensure_ascii=False))
    return 0


def _validate(spark: SparkSession, a: argparse.Namespace) -> int:
    from batchlens.sinks.review import review, validation

    found = validation(spark, a.template, a.export)
    print(review(found))
    return 1 if found["error"] else 0


def _accept(spark: SparkSession, a: argparse.Namespace) -> int:
    """Write a template that reads the export to a folder where ``check`` finds it by its id."""
    from pathlib import Path

    from batchlens.sinks.review import accepted, review, validation

    found = validation(spark, a.template, a.export)
    print(review(found))
    if found["error"]:
        return 1
    print("written:", accepted(Path(a.template).read_text(encoding="utf-8"), a.id, a.folder))
    return 0


if __name__ == "__main__":
    sys.exit(main())
