"""The reference-material library: one YAML file a material."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

VALUES = "lib_pos int, crm_id string, unit string, element string, value double, uncertainty double, value_type string"
PATTERNS = "lib_pos int, crm_id string, pattern string"
HERE = Path(__file__).parent.parent / "packs"


def library_folder(name: str) -> Path:
    """A folder as given, else in ./configs or among the files that come with the package."""
    for path in (Path(name), Path("configs") / name, HERE / name):
        if path.is_dir():
            return path
    raise FileNotFoundError(f"CRM library unavailable: {name!r}")


def load_library(name: str) -> tuple[list[tuple], list[tuple], list[tuple[str, list[str]]]]:
    """Rows of values and of name patterns, and the elements without a value, of all files by name."""
    values, patterns, unfilled = [], [], []
    for pos, path in enumerate(sorted(library_folder(name).glob("*.yaml"))):
        data = yaml.safe_load(path.read_text(encoding="utf-8"))
        if not isinstance(data, dict) or not data.get("id") or not data.get("unit"):
            raise ValueError(f"CRM library unavailable: {path.name} has no id or unit")
        kind, empty = data.get("default_value_type", "certified"), []
        for element, entry in (data.get("certified") or {}).items():
            entry = entry if isinstance(entry, dict) else {"value": entry}
            if entry.get("value") is None:
                empty.append(element)
                continue
            own = entry.get("type", kind)
            if own not in ("certified", "reference", "information"):
                raise ValueError(f"CRM library unavailable: {path.name}: unknown value type {own!r}")
            uncertainty = entry.get("uncertainty")
            values.append((pos, data["id"], data["unit"], element, float(entry["value"]), None if uncertainty is None else float(uncertainty), own))
        patterns += [(pos, data["id"], p.replace("(?P<", "(?<")) for p in (data.get("match") or {}).get("name_patterns", [])]
        unfilled.append((data["id"], empty))
    return values, patterns, unfilled


def library_frames(spark: SparkSession, name: str = "crm") -> tuple[DataFrame, DataFrame]:
    """The library as tables of values and of patterns."""
    values, patterns, _ = load_library(name)
    return spark.createDataFrame(values, VALUES), spark.createDataFrame(patterns, PATTERNS)
