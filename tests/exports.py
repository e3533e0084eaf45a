"""Made-up exports for tests: one run of a calibrated instrument."""

from __future__ import annotations

import csv
import random

ANALYTES = ["9 Be", "52 Cr [He]", "60 Ni [He]", "63 Cu [He]", "66 Zn [He]", "75 As [He]", "111 Cd", "208 Pb"]
ISTDS = ["45 Sc", "115 In", "209 Bi"]
CRM = [20.0, 40.0, 30.0, 60.0, 80.0, 15.0, 10.0, 25.0]


def sequence() -> list[tuple[str, str, float | None, float]]:
    """name, type, level, true concentration of each sample of the run."""
    rows: list[tuple[str, str, float | None, float]] = [("Cal Blank", "CalBlk", None, 0.0)]
    rows += [(f"Cal Std {x} ppb", "CalStd", float(x), float(x)) for x in (1, 5, 10, 50, 100)]
    rows += [("ICV-50", "ICV", 50.0, 50.0), ("ICB", "ICB", None, 0.0), ("MB-1", "MB", None, 0.0), ("LCS-25", "LCS", 25.0, 25.0), ("CRM-EXAMPLE-1", "LCS", None, -1.0)]
    for i in range(1, 15):
        rows.append((f"S{i:03}", "Sample", None, 2.0 + 3 * i))
        if i == 3:
            rows.append(("S003-DUP", "Dup", None, 11.0))
        if i == 5:
            rows += [("S005-MS", "MS", 25.0, 42.0), ("S005-MSD", "MSD", 25.0, 42.0)]
        if i in (4, 9):
            rows += [(f"CCV-50 #{1 + (i > 4)}", "CCV", 50.0, 50.0), (f"CCB #{1 + (i > 4)}", "CCB", None, 0.0)]
    return rows + [("CCV-50 #3", "CCV", 50.0, 50.0), ("CCB #3", "CCB", None, 0.0)]


def wide_export(path: str, violations: bool = False, edits: dict | None = None, bom: bool = False, rename: dict | None = None) -> list[str]:
    """Write the run as a wide export; ``edits`` replaces cells by (sample, column)."""
    rng = random.Random(5)
    header = ["Seq", "Sample Name", "Type", "Level [ppb]", *(f"{a} Conc. [ppb]" for a in ANALYTES), *(f"{a} CPS" for a in ANALYTES), *(f"{a} CPS RSD" for a in ANALYTES), *(f"{a} CPS (ISTD)" for a in ISTDS)]
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow([(rename or {}).get(h, h) for h in header])
        for seq, (name, kind, level, true) in enumerate(sequence(), 1):
            conc, cps = [], []
            for k in range(len(ANALYTES)):
                value = CRM[k] if true < 0 else true
                if violations and name == "CCV-50 #1":
                    value *= 0.85
                if violations and kind == "Dup":
                    value *= 1.35
                conc.append(max(0.0, value * rng.uniform(0.985, 1.015)) + (rng.uniform(0.005, 0.012) if value == 0 else 0))
                cps.append(conc[-1] * 2000 * rng.uniform(0.995, 1.005) + 5)
            istd = [500_000 * rng.uniform(0.97, 1.03) * (0.65 if violations and name in ("S013", "S014") else 1) for _ in ISTDS]
            rsd = [max(0.3, 100 / max(c, 1) ** 0.5) for c in cps]
            row = dict(zip(header, [seq, name, kind, "" if level is None else f"{level:g}", *(f"{c:.4f}" for c in conc), *(f"{c:.0f}" for c in cps), *(f"{x:.2f}" for x in rsd), *(f"{x:.0f}" for x in istd)]))
            for (sample, column), value in (edits or {}).items():
                if sample == name:
                    row[column] = value
            out.writerow([row[h] for h in header])
    return header
