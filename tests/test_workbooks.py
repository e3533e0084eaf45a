"""Workbooks: written here as zips of XML, read by the package's own decoder."""

import zipfile

import pytest

from batchlens.sources.cells import read_workbook_cells
from batchlens.sources.detect import read_batch
from batchlens.sources.transposed import read_emission_workbook, sheet_agreement
from batchlens.sources.xlsx import is_date_format, when, workbook_rows

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def column(i):
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def escaped(text):
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def write_book(path, sheets, shared=True, merges=None, late=False, raw=None):
    """``sheets``: title -> rows of cells; numbers, strings, booleans, ("date", serial), None; ``raw`` replaces a sheet's XML of rows."""
    strings, parts = [], {}

    def cell(r, c, v):
        ref = f"{column(c)}{r + 1}"
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, tuple):
            return f'<c r="{ref}" s="1"><v>{v[1]}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if shared:
            strings.append(v)
            return f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><r><t>{escaped(v[:1])}</t></r><r><t xml:space="preserve">{escaped(v[1:])}</t></r><rPh sb="0" eb="1"><t>hint</t></rPh></is></c>'

    for i, (title, rows) in enumerate(sheets.items(), 1):
        body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
        spans = "".join(f'<mergeCell ref="{m}"/>' for m in (merges or {}).get(title, []))
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{MAIN}"><sheetData>{(raw or {}).get(title, body)}</sheetData><mergeCells>{spans}</mergeCells></worksheet>'
    parts["xl/workbook.xml"] = f'<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><workbookPr date1904="{int(late)}"/><sheets>' + "".join(f'<sheet name="{escaped(t)}" sheetId="{i}" r:id="rId{i}"/>' for i, t in enumerate(sheets, 1)) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i % 2 else ""}worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>"
    parts["xl/styles.xml"] = f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd&quot; d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>'
    if shared:
        parts["xl/sharedStrings.xml"] = f'<sst xmlns="{MAIN}">' + "".join(f"<si><t>{escaped(s)}</t></si>" for s in strings) + "</sst>"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return str(path)


def emission_sheets(filled=True, other=None, extra_row=()):
    """The three sheets of a run; ``other`` replaces the second line of the intensities."""
    runs = [("HNO3 blank", None, None), ("100 ppb U", 101.0, 99.0), ("250 ppb U", 248.0, 252.0), ("unknown-1", 57.5, 41.0)]

    def sheet(unit, values, second="U 367.007"):
        head = ["", "Sample Id", "Acquisition Time", f"U 385.958\n({unit})", f"{second}\n({unit})"]
        return [head, *([i, name, ("date", 45000 + i), a, b] for i, (name, a, b) in enumerate(values, 1)), *extra_row]

    return {
        "Conc. in Sample Units": sheet("mg/L", runs if filled else [(n, None, None) for n, _, _ in runs]),
        " corrected intensities": sheet("cps", [(n, 2000.0, 2100.0) for n, _, _ in runs], other or "U 367.007"),
        "Corrected Intensities RSDs": sheet("%", [(n, 1.2, 30.0) for n, _, _ in runs]),
        "Notes": [["anything", True, 3]],
    }


@pytest.mark.parametrize("shared", [True, False])
def test_cells(tmp_path, shared):
    long = "x" * 40_000
    rows = [["a & b", None, 1, 2.5, True, ("date", 45000), ("date", 45000.75), ("date", 0.5)], [], ["line\nbreak", "tab_x0009_bed", 1e-9, -3, 0.1 + 0.2], [long]]
    path = write_book(tmp_path / "x.xlsx", {"S <1>": rows, "Empty": [], "Last": [["z"]]}, shared)
    assert list(workbook_rows(path)) == [
        ("S <1>", 0, [(0, "a & b"), (2, "1"), (3, "2.5"), (5, "2023-03-15 00:00:00"), (6, "2023-03-15 18:00:00"), (7, "12:00:00")]),
        ("S <1>", 2, [(0, "line\nbreak"), (1, "tab\tbed"), (2, "1e-09"), (3, "-3"), (4, "0.30000000000000004")]),
        ("S <1>", 3, [(0, long)]), ("Last", 0, [(0, "z")]),
    ]


def test_dates_and_formats():
    assert when(59, False) == "1900-02-28 00:00:00" and when(61, False) == "1900-03-01 00:00:00" and when(1, True) == "1904-01-02 00:00:00"
    assert [is_date_format(f) for f in ("yyyy-mm-dd", "[h]:mm", "0.00", '"days" 0', "[Red]0.0", "General", "#,##0 \\d", "mmm d;@")] == [True, True, False, False, False, False, False, True]


def test_merged_ranges(tmp_path):
    path = write_book(tmp_path / "m.xlsx", {"S": [["top", None, "x"], [None, None, "y"], ["side"], [None, "own"]]}, merges={"S": ["A1:B2", "A3:A4"]})
    assert list(workbook_rows(path)) == [("S", 0, [(0, "top"), (2, "x")]), ("S", 1, [(2, "y")]), ("S", 2, [(0, "side")]), ("S", 3, [(1, "own")])]
    spread = list(workbook_rows(path, spread=True))
    assert spread == [("S", 0, [(0, "top"), (1, "top"), (2, "x")]), ("S", 1, [(0, "top"), (1, "top"), (2, "y")]), ("S", 2, [(0, "side")]), ("S", 3, [(0, "side"), (1, "own")])]


def test_cells_without_references_and_formulas(tmp_path):
    raw = '<row><c><v>1</v></c><c t="str"><f>A1&amp;"x"</f><v>1x</v></c></row><row r="4"><c t="e"><v>#DIV/0!</v></c><c r="AB4" t="d"><v>2024-01-05T10:00:00</v></c></row>'
    path = write_book(tmp_path / "f.xlsx", {"S": []}, raw={"S": raw})
    assert list(workbook_rows(path)) == [("S", 0, [(0, "1"), (1, "1x")]), ("S", 3, [(0, "#DIV/0!"), (27, "2024-01-05 10:00:00")])]


def test_rows_are_streamed(tmp_path):
    path = write_book(tmp_path / "big.xlsx", {"S": [[i, f"name {i}", i / 7] for i in range(30_000)]})
    rows = workbook_rows(path)
    assert next(rows) == ("S", 0, [(0, "0"), (1, "name 0"), (2, "0.0")]) and sum(1 for _ in rows) == 29_999


def test_workbook_cells_in_batches_and_broken_files(spark, tmp_path):
    write_book(tmp_path / "a.xlsx", {"S": [[1, 2, 3]] * 50})
    (tmp_path / "b.xlsx").write_bytes(b"not a zip")
    (tmp_path / "c.xlsx").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("other.txt", "x")
    got = read_workbook_cells(spark, str(tmp_path), most=7)
    assert got.where("note is null").count() == 150 and got.where("value = '2' and col = 1").count() == 50
    assert sorted(r["path"][-6:] for r in got.where("note is not null").collect()) == ["b.xlsx", "d.xlsx"]  # Spark passes over files without bytes


def test_emission_workbook(spark, tmp_path):
    path = write_book(tmp_path / "oes.xlsx", emission_sheets())
    d = read_batch(spark, path)
    b = d.frames
    assert d.reader == "emission workbook" and b.batches.first()["warnings"] == [] and b.batches.first()["instrument_family"] == "agilent-icp-oes"
    assert [r["label"] for r in b.analytes.orderBy("pos").collect()] == ["U 385.958", "U 367.007"]
    types = {r["name"]: (r["type"], r["level"]) for r in b.samples.collect()}
    assert types == {"HNO3 blank": ("CAL_BLANK", None), "100 ppb U": ("CAL_STD", 100.0), "250 ppb U": ("CAL_STD", 250.0), "unknown-1": ("SAMPLE", None)}
    r = b.results.where("label = 'U 385.958' and row_pos = 2").first()
    assert (r["conc"], r["intensity"], r["rsd_pct"], r["unit"]) == (101.0, 2000.0, 1.2, "mg/L")


def test_unquantified_run_keeps_its_intensities(spark, tmp_path):
    b = read_emission_workbook(spark, write_book(tmp_path / "oes.xlsx", emission_sheets(filled=False), shared=False))
    r = b.results.where("label = 'U 385.958' and row_pos = 2").first()
    assert (r["conc"], r["intensity"], r["rsd_pct"]) == (None, 2000.0, 1.2)


def test_sheets_that_list_other_lines_are_skipped(spark, tmp_path):
    one = write_book(tmp_path / "one.xlsx", emission_sheets(other="U 409.013"))
    two = write_book(tmp_path / "two.xlsx", emission_sheets())
    three = emission_sheets()
    three["Corrected Intensities RSDs"] = [row[:4] for row in three["Corrected Intensities RSDs"]]  # a line less
    three = write_book(tmp_path / "three.xlsx", three)
    calib = emission_sheets()
    calib["Conc. in Calib Units"] = calib.pop("Conc. in Sample Units")
    four = write_book(tmp_path / "four.xlsx", calib)
    got = {(r["path"][-8:], r["kind"]): r["agrees"] for r in sheet_agreement(read_workbook_cells(spark, [one, two, three, four])).collect()}
    assert got == {(p, k): (p, k) not in ((one[-8:], "intensity"), (three[-8:], "rsd_pct")) for p in (one[-8:], two[-8:], three[-8:], four[-8:]) for k in ("intensity", "rsd_pct")}
    b = read_emission_workbook(spark, [one, two, three, four])
    warnings = {r["batch_id"][-8:]: r["warnings"] for r in b.batches.collect()}
    assert warnings == {one[-8:]: ["sheet ' corrected intensities' lists different emission lines and was skipped"], two[-8:]: [], three[-8:]: ["sheet 'Corrected Intensities RSDs' lists different emission lines and was skipped"], four[-8:]: []}
    count = lambda path, c: b.results.where(f"batch_id like '%{path[-8:]}' and {c} is not null").count()
    assert [count(one, c) for c in ("conc", "intensity", "rsd_pct")] == [6, 0, 8] and [count(three, c) for c in ("conc", "intensity", "rsd_pct")] == [6, 8, 0] and count(four, "conc") == 6


def test_other_workbooks_are_refused(spark, tmp_path):
    path = write_book(tmp_path / "other.xlsx", {"Sheet1": [["something", "else"]]})
    with pytest.raises(ValueError, match="not an emission workbook"):
        read_batch(spark, path)
