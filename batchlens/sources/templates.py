"""Layout templates: YAML files that say which columns of an export hold what.

Headers and names are described by patterns (Python regular expressions with named groups) or, as in the templates that
come with the package, in words: ``headers`` has for each kind of column the header as it is written, with
``{label}`` and ``{unit}`` in it; ``names`` has words, and units after a number, that give a sample's type; ``level_units``
has the units after which a name's number is its level. These are turned into patterns once, when a template is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

import yaml

from batchlens.model import SAMPLE_TYPES
from batchlens.plans.packs import resolve


PATTERN_OF = {"conc": "analyte_conc_pattern", "cps": "analyte_cps_pattern", "rsd": "analyte_rsd_pattern", "istd": "istd_cps_pattern"}


@dataclass(frozen=True)
class Template:
    """One layout. Patterns are Python regular expressions with named groups."""

    id: str
    instrument_family: str = ""
    columns: dict = field(default_factory=dict)
    analyte_conc_pattern: str | None = None
    analyte_cps_pattern: str | None = None
    analyte_rsd_pattern: str | None = None
    istd_cps_pattern: str | None = None
    istd_label_pattern: str | None = None
    sample_type_vocab: dict = field(default_factory=dict)
    parent_rules: tuple = ()
    encoding: str = "utf-8-sig"
    header_rows: int = 1
    header_group_labels: tuple = ()
    ignore_patterns: tuple = ()
    expected_conc_from_name: str | None = None
    level_is_index: bool = False
    layout: str = "columns"
    sample_type_patterns: tuple = ()
    default_sample_type: str | None = None


def load_template(name: str) -> Template:
    """Read a template by name or path; aliases are followed."""
    seen: list[str] = []
    while True:
        try:
            data = yaml.safe_load(resolve(name, "template").read_text(encoding="utf-8"))
        except yaml.YAMLError as error:
            raise ValueError(f"template {name!r} isn't valid YAML: {error}") from error
        if not isinstance(data, dict) or not data.get("id"):
            raise ValueError(f"template {name!r} has no id")
        if not data.get("alias_of"):
            return template_of(data)
        seen.append(name)
        name = data["alias_of"]
        if name in seen:
            raise ValueError(f"templates alias each other: {', '.join(seen)}")


def header_pattern(written: str) -> str:
    """The pattern of a header as it is written; spaces in it may be any white space or none."""
    parts = re.split(r"(\{label\}|\{unit\}| +)", written)
    known = {"{label}": "(?P<label>.+?)", "{unit}": "(?P<unit>[^]]+)"}
    return "^" + "".join(known.get(p) or (r"\s*" if p.isspace() else re.escape(p)) for p in parts if p) + "$"


def _either(words: list[str]) -> str:
    return "(?:" + "|".join(r"\s*".join(map(re.escape, w.split())) for w in words) + ")"


def name_pattern(rule: dict) -> str:
    """The pattern of names that have one of a rule's words (anywhere, at the start, or alone) or units after a number."""
    if rule.get("units"):
        return rf"(?i)\b[0-9]+(?:[.][0-9]+)?\s*{_either(rule['units'])}\b"
    where = {"start": r"(?i)^\s*{}\b", "alone": r"(?i)^\s*{}\s*$"}.get(rule.get("at"), r"(?i)\b{}\b")
    return where.replace("{}", _either(rule["words"]))


def _in_patterns(data: dict) -> dict:
    """``headers``, ``names`` and ``level_units`` as the patterns they stand for."""
    out = dict(data)
    for kind, written in (data.get("headers") or {}).items():
        written = [written] if isinstance(written, str) else written
        patterns = [header_pattern(w) for w in written]
        if kind == "ignored":
            out["ignore_patterns"] = [*out.get("ignore_patterns", []), *patterns]
        else:
            out[PATTERN_OF[kind]] = patterns[0] if len(patterns) == 1 else tuple(patterns)
    if data.get("names"):
        out["sample_type_patterns"] = [{"pattern": name_pattern(r), "type": r["type"]} for r in data["names"]]
    if data.get("level_units"):
        out["expected_conc_from_name"] = rf"(?i)(?P<value>[0-9]+(?:[.][0-9]+)?)\s*{_either(data['level_units'])}"
    return out


def template_of(data: dict) -> Template:
    """A template from its parsed YAML, checked."""
    data = _in_patterns(data)
    names = {f.name for f in fields(Template)}
    t = Template(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items() if k in names})
    if t.layout == "columns" and not (t.analyte_conc_pattern or t.analyte_cps_pattern):
        raise ValueError(f"template {t.id!r} needs a pattern for concentrations or counts")
    types = [*t.sample_type_vocab.values(), *(p["type"] for p in t.sample_type_patterns), *(r["type"] for r in t.parent_rules), *filter(None, [t.default_sample_type])]
    if bad := sorted({x for x in types if x not in SAMPLE_TYPES}):
        raise ValueError(f"template {t.id!r} names unknown sample types: {', '.join(bad)}")
    return t


def classify(t: Template, names: list[str]) -> list[tuple[str, str, str | None, str | None]]:
    """(name, kind, label, unit) of header names. Headers are few, so this runs on the driver.

    The first kind that fits wins: a fixed column, precision, ignored, an internal standard, a concentration, counts.
    """
    fixed = {v: k for k, v in t.columns.items()}
    match = lambda p, n: next((m for x in ((p,) if isinstance(p, str) else p or ()) if (m := re.match(x, n))), None)
    out = []
    for n in names:
        kind, label, unit = "unmapped", None, None
        if n in fixed:
            kind = fixed[n]
        elif m := match(t.analyte_rsd_pattern, n):
            kind, label = "rsd", m["label"]
        elif any(re.search(p, n) for p in t.ignore_patterns):
            kind = "ignored"
        elif t.istd_label_pattern and re.search(t.istd_label_pattern, n):
            kind, label = "istd", n.split("::")[0]
        elif m := match(t.istd_cps_pattern, n):
            kind, label = "istd", m["label"]
        elif m := match(t.analyte_conc_pattern, n):
            kind, label, unit = "conc", m["label"], (m.groupdict().get("unit") or "ppb").strip()
        elif m := match(t.analyte_cps_pattern, n):
            kind, label = "cps", m["label"]
        out.append((n, kind, label.strip() if label else None, unit))
    return out


def collapse(rows: list[list[str]], group_labels: tuple = ()) -> list[str]:
    """The names of a file's columns from its one or two header rows; what ``tables.collapsed_headers`` does for tables of headers."""
    rows = [[(v or "").strip() for v in r] for r in rows]
    if len(rows) == 1:
        return rows[0]
    out, span = [], None
    for c in range(max(map(len, rows))):
        top, sub = (r[c] if c < len(r) else "" for r in rows)
        top = "" if re.match(r"Unnamed:\s*\d+$", top) else top
        span = top or span
        if sub:
            out.append(sub if span is None or span in group_labels else f"{span} :: {sub}")
        else:
            out.append(top if top and span not in group_labels else span if span in group_labels else f"(unnamed column {c})")
    return out
