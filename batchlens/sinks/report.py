"""A batch's results as JSON and as an HTML page, and many batches' results as Parquet (their reports: ``reports``)."""

from __future__ import annotations

import html
import json
from dataclasses import fields
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.model import BatchFrames


def batch_report(b: BatchFrames, results: DataFrame, details: DataFrame, batch_id: str) -> dict:
    """Everything about one batch; for many, use ``reports.write_reports``."""
    from batchlens.sinks.reports import report_rows

    own = lambda d: d.where(F.col("batch_id") == batch_id)
    row = report_rows(BatchFrames(*(own(getattr(b, f.name)) for f in fields(b))), own(results), own(details)).first()
    if row is None:
        raise ValueError(f"no batch {batch_id!r}")
    return assembled(row.asDict(recursive=True))


def assembled(row: dict) -> dict:
    """The report of a row of ``reports.report_rows``."""
    analytes = [a for a in row["analytes"] or [] if a["role"] == "analyte"]
    counts = {t["type"]: t["n"] for t in row["types"] or []}
    checks = []
    for c in row["checks"] or []:
        rows = [{**json.loads(r["payload"]), "ok": r["ok"]} for r in c["rows"] or []]
        checks.append({k: c[k] for k in ("check_id", "outcome", "reason", "verify")} | {"details": sorted(rows, key=lambda d: (d.get("row_pos") or 0, str(d.get("label", ""))))})
    return {
        "schema_version": "0.1", "generated_by": "batchlens", "generated_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "batch": {
            "source": row["source_path"], "template": row["template_id"], "instrument_family": row["instrument_family"], "n_samples": sum(counts.values()), "sample_type_counts": counts,
            "analytes": [a["label"] for a in analytes], "istds": [a["label"] for a in row["analytes"] or [] if a["role"] == "istd"],
            "analyte_detail": [{k: a[k] for k in ("label", "mass", "element", "mass_shift", "mode", "wavelength_nm")} for a in analytes], "warnings": row["warnings"] or [],
        },
        "verdict": "FAIL" if any(c["outcome"] == "FAIL" for c in checks) else "PASS", "checks": checks,
    }


def as_html(report: dict) -> str:
    """The report as one page."""
    e = lambda v: html.escape("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v))
    batch, parts = report["batch"], []
    for c in report["checks"]:
        keys = list(dict.fromkeys(k for d in c["details"] for k in d))
        body = "".join("<tr>" + "".join(f"<td>{e(d.get(k))}</td>" for k in keys) + "</tr>" for d in c["details"])
        table = f"<table><tr>{''.join(f'<th>{e(k)}</th>' for k in keys)}</tr>{body}</table>" if keys else ""
        parts.append(f"<section><h2>{e(c['check_id'])} <b class={c['outcome'].lower()}>{e(c['outcome'])}</b></h2><p>{e(c['reason'])}</p><p><i>{e(c['verify'])}</i></p>{table}</section>")
    warnings = "".join(f"<li>{e(w)}</li>" for w in batch["warnings"])
    counts = ", ".join(f"{e(k)} {v}" for k, v in batch["sample_type_counts"].items())
    style = "body{font-family:sans-serif}td,th{border:1px solid #ccc;padding:2px 6px}table{border-collapse:collapse}.fail{color:#b00}.pass{color:#070}.warn{color:#a60}"
    return (
        f"<!doctype html><meta charset=utf-8><title>{e(batch['source'])}</title><style>{style}</style><h1>{e(batch['source'])}: <b class={report['verdict'].lower()}>{e(report['verdict'])}</b></h1>"
        f"<p>{e(batch['template'])}; {batch['n_samples']} samples ({counts})</p><p>Analytes: {e(', '.join(batch['analytes']))}. Internal standards: {e(', '.join(batch['istds']))}.</p><ul>{warnings}</ul>{''.join(parts)}"
    )


def write_report(report: dict, folder: str) -> tuple[Path, Path]:
    """qc_report.html and qc_report.json in a local folder."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    pages = out / "qc_report.html", out / "qc_report.json"
    pages[0].write_text(as_html(report), encoding="utf-8")
    pages[1].write_text(json.dumps(report, indent=2, ensure_ascii=False), encoding="utf-8")
    return pages


def write_results(results: DataFrame, details: DataFrame, path: str) -> None:
    """Results and details of any number of batches, partitioned by check."""
    results.write.mode("overwrite").partitionBy("check_id").parquet(f"{path}/results")
    details.write.mode("overwrite").partitionBy("check_id").parquet(f"{path}/details")
