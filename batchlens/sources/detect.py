"""Which reader and template an export needs."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from batchlens.model import BatchFrames, cut
from batchlens.sources import transposed, wide
from batchlens.sources.cells import read_cells
from batchlens.sources.tables import attach_intensities
from batchlens.sources.templates import load_template
from batchlens.sources.transposed import has_metadata

CANDIDATES = ("masshunter_2row", "masshunter_quant_wide")
# The word that a concentrations file adds to the name of its counts file, and the words that pairs of files swap.
ADDED = ("conc", "concentration")
SWAPPED = (("count", "conc"), ("Count", "Conc"), ("COUNT", "CONC"))


@dataclass(frozen=True)
class Detection:
    """A batch and how it was read."""

    frames: BatchFrames
    reader: str
    template: str
    companion: str | None = None


def score(b: BatchFrames) -> tuple[int, int, int]:
    """Analytes found, then fewer unmapped columns, then fewer samples of no known type."""
    n = b.analytes.where("role = 'analyte'").count()
    unmapped = b.batches.select(F.sum(F.size(F.filter("warnings", lambda w: w.startswith("unmapped"))))).first()[0] or 0
    return n, -int(unmapped), -b.of_type("OTHER").count()


def companion_names(name: str) -> list[str]:
    """Names that the other file of a pair may have, the likeliest first: without an added word, else with the other word of a pair."""
    p = Path(name)
    words = [f"{sep}{w}" for w in ADDED for sep in "_- "]
    names = [p.stem[: -len(w)] + p.suffix for w in words if p.stem.lower().endswith(w)]
    for pair in SWAPPED:
        names += [p.name.replace(a, b, 1) for a, b in (pair, pair[::-1]) if a in p.stem]
    return [n for n in names if n != p.name]


def companion(path: str) -> str | None:
    """The other file of a pair, by name."""
    p = Path(path)
    return next((str(other) for n in companion_names(p.name) if (other := p.with_name(n)).is_file()), None)


def delimiter_of(path: str) -> str:
    """A tab where the first line of a file with any has more of them than commas."""
    with open(path, "rb") as f:
        line = next((x for x in f if x.strip()), b"")
    return "\t" if line.count(b"\t") > line.count(b",") else ","


def read_batch(spark: SparkSession, path: str, template: str | None = None, counts: str | None = None) -> Detection:
    """Read one export. A template picks its reader; without one, the layout that fits best is taken (the earlier on ties)."""
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(path)
    found = _read(spark, p, template)
    counts = counts or (None if found.frames.results.where("intensity is not null").limit(1).count() else companion(path))
    if not counts:
        return found
    other = _read(spark, Path(counts), None if template is None else template)
    one = found.frames.batches.first()["batch_id"]
    renamed = BatchFrames(*(getattr(other.frames, n).withColumn("batch_id", F.lit(one)) for n in ("batches", "analytes", "samples", "results", "istd", "flags")))
    return Detection(attach_intensities(found.frames, renamed), found.reader, found.template, counts)


def _read(spark: SparkSession, p: Path, template: str | None) -> Detection:
    if p.is_dir():
        return Detection(transposed.read_isotope_folder(spark, str(p), template or "element_ascii"), "isotope folder", template or "element_ascii")
    if p.suffix.lower() in (".xlsx", ".xlsm"):
        return Detection(transposed.read_emission_workbook(spark, str(p), template or "agilent_oes"), "emission workbook", template or "agilent_oes")
    tabs = p.suffix.lower() == ".asc" or delimiter_of(str(p)) == "\t"
    if load_template(template).layout == "transposed" if template else tabs:
        name = template or "element_ascii"
        if has_metadata(read_cells(spark, str(p), "utf-8-sig", "\t")):
            return Detection(transposed.read_isotope_folder(spark, str(p), name), "isotope file", name)
        return Detection(transposed.read_isotope_summary(spark, str(p), name), "isotope summary", name)
    if template:
        return Detection(wide.read_wide(spark, str(p), template), "wide", template)
    best = None
    for name in CANDIDATES:
        t = load_template(name)
        cells = cut(read_cells(spark, str(p), t.encoding))
        got = wide.fit(cells, t).first()
        got = (got["analytes"], -got["unmapped"], -got["strange"]) if got else (0, 0, 0)
        if got[0] and (best is None or got > best[0]):
            best = (got, name, cells)
    if best is None:
        raise ValueError(f"no layout fits {p}: no analyte columns matched any of {', '.join(CANDIDATES)}")
    return Detection(wide.wide_frames(best[2], load_template(best[1])), "wide", best[1])
