"""What a template makes of an export, for a person who decides whether to keep it."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import SparkSession

from batchlens.sources.detect import read_batch
from batchlens.sources.templates import template_of

MOST = 10


def validation(spark: SparkSession, template: str, export: str) -> dict:
    """error, or else what was read: analytes, internal standards, samples by type, warnings."""
    try:
        b = read_batch(spark, export, template).frames.cached()
        labels = {role: [r["label"] for r in b.analytes.where(f"role = '{role}'").orderBy("pos").collect()] for role in ("analyte", "istd")}
        types = {r["type"]: r["count"] for r in b.samples.groupBy("type").count().orderBy("type").collect()}
        return {"error": None, "analytes": labels["analyte"], "istds": labels["istd"], "types": types, "warnings": list(b.batches.first()["warnings"])}
    except (OSError, ValueError, RuntimeError, TypeError, KeyError) as error:
        return {"error": f"{type(error).__name__}: {error}"}


def review(found: dict) -> str:
    """The findings of ``validation`` as lines: what was read, then every gap."""
    if found["error"]:
        return f"The template doesn't read this export: {found['error']}"
    by_kind = {k: [w for w in found["warnings"] if w.startswith(k)] for k in ("unmapped", "unrecognised")}
    other, lines = found["types"].get("OTHER", 0), []
    for title, names in (("analytes", found["analytes"]), ("internal standards", found["istds"])):
        lines.append(f"{title}: {len(names)}" + (f" ({', '.join(names[:MOST])}{', ...' if len(names) > MOST else ''})" if names else ""))
    lines.append(f"samples: {sum(found['types'].values())} (" + ", ".join(f"{n} {k}" for k, n in found["types"].items()) + ")")
    gaps = [f"{other} sample(s) of no known type: checks that need them won't be evaluated"] if other else []
    for kind in by_kind.values():
        gaps += kind[:MOST] + [f"and {len(kind) - MOST} more"] * (len(kind) > MOST)
    gaps += [w for w in found["warnings"] if not w.startswith(tuple(by_kind))]
    if not found["analytes"]:
        gaps.append("no analyte was found")
    return "\n".join(lines + [f"! {g}" for g in gaps] + ["Look at the lines marked ! before you keep this template." if gaps else "Everything in the export is accounted for."])


def accepted(text: str, template_id: str, folder: str = "configs") -> Path:
    """Check a template's YAML, give it an id, and write it to ``folder`` under that name."""
    data = yaml.safe_load(text)
    if not isinstance(data, dict):
        raise ValueError("a template is a mapping")
    data["id"] = template_id
    template_of(data)
    path = Path(folder) / f"{template_id}.template.yaml"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump(data, sort_keys=False, allow_unicode=True), encoding="utf-8")
    return path
