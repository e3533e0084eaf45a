"""Workbooks (.xlsx, .xlsm) read as a stream of rows, with nothing but the standard library.

A workbook is a zip of XML parts. The parts that say what a cell means (sheet names, shared strings, which formats are dates) are
read first; a sheet's part is then read event by event, so of the cells only one row is held at a time.
Formulas give the values that were saved with them.
"""

from __future__ import annotations

import datetime
import re
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.etree.ElementTree import ParseError, iterparse

_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
# Numbers of the built-in formats that are dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_QUOTED = re.compile(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.I)


def _name(tag: str) -> str:
    """The tag without its namespace; files are written with either of two."""
    return tag.rpartition("}")[2]


def _elements(book: zipfile.ZipFile, part: str, *wanted: str):
    """The closed elements of these names, one by one; what was read is let go."""
    with book.open(part) as f:
        path = []
        for event, e in iterparse(f, ("start", "end")):
            if event == "start":
                path.append(e)
                continue
            path.pop()
            if _name(e.tag) in wanted:
                yield e
                e.clear()
                if path:
                    path[-1].remove(e)


def _text(e) -> str:
    """The text of a string item: its runs, without phonetic hints."""
    out = []
    for child in e:
        if _name(child.tag) == "t":
            out.append(child.text or "")
        elif _name(child.tag) == "r":
            out += [t.text or "" for t in child if _name(t.tag) == "t"]
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(out))


def _of(e, name: str) -> str | None:
    """An attribute by its name without namespace."""
    return next((v for k, v in e.attrib.items() if _name(k) == name), None)


def is_date_format(code: str) -> bool:
    """Whether a number format shows a date or a time."""
    return bool(re.search("[dmyhs]", _QUOTED.sub("", code.split(";")[0]), re.I))


def _dates(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style whether its numbers are dates."""
    if "xl/styles.xml" not in book.namelist():
        return []
    own, out = {}, []
    for e in _elements(book, "xl/styles.xml", "numFmt", "cellXfs"):
        if _name(e.tag) == "numFmt":
            own[int(e.get("numFmtId", 0))] = is_date_format(e.get("formatCode", ""))
        else:
            out = [own.get(n, n in DATE_FORMATS) for n in (int(x.get("numFmtId", 0)) for x in e)]
    return out


def _sheets(book: zipfile.ZipFile) -> tuple[list[tuple[str, str]], bool]:
    """(title, part) of the sheets in order, and whether days count from 1904."""
    targets = {}
    for e in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship"):
        target = e.get("Target", "")
        targets[e.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    sheets, late = [], False
    for e in _elements(book, "xl/workbook.xml", "sheet", "workbookPr"):
        if _name(e.tag) == "workbookPr":
            late = e.get("date1904", "0") in ("1", "true")
        elif (part := targets.get(_of(e, "id"))) in book.namelist() and "chartsheet" not in part:
            sheets.append((e.get("name", ""), part))
    return sheets, late


def when(serial: float, late: bool) -> str:
    """A day number as a time stamp, or a time where it has no day. Day 60 of the earlier calendar never was."""
    if 0 <= serial < 1:
        return str((datetime.datetime(1900, 1, 1) + datetime.timedelta(seconds=round(serial * 86400))).time())
    start = datetime.datetime(1904, 1, 1) if late else datetime.datetime(1899, 12, 30 if serial >= 60 else 31)
    try:
        return str(start + datetime.timedelta(seconds=round(serial * 86400)))
    except OverflowError:
        return str(serial)


def _number(text: str) -> str:
    """A number as it is written without a format: whole ones without a point."""
    return text if re.fullmatch(r"-?[0-9]+", text) else repr(float(text))


def _column(reference: str) -> int:
    out = 0
    for c in reference:
        if not c.isalpha():
            break
        out = out * 26 + ord(c.upper()) - 64
    return out - 1


def _merged(book: zipfile.ZipFile, part: str) -> dict[tuple[int, int], tuple[int, int]]:
    """Of each cell in a merged range the range's first cell."""
    out = {}
    for e in _elements(book, part, "row", "mergeCell"):
        if _name(e.tag) == "mergeCell":
            a, _, b = e.get("ref", "").partition(":")
            (r1, c1), (r2, c2) = ((int(re.sub("[^0-9]", "", x)) - 1, _column(x)) for x in (a, b or a))
            out |= {(r, c): (r1, c1) for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)}
    return out


def _value(e, strings: list[str], dates: list[bool], late: bool) -> str | None:
    kind, text = e.get("t", "n"), None
    for child in e:
        if _name(child.tag) == "is":
            return _text(child)
        if _name(child.tag) == "v":
            text = child.text
    if text is None or kind == "b":
        return None
    if kind == "s":
        return strings[int(text)]
    if kind in ("str", "e"):
        return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)
    if kind == "d":
        return text.replace("T", " ")
    style = int(e.get("s", 0))
    return when(float(text), late) if style < len(dates) and dates[style] else _number(text)


def workbook_rows(file: str | IO[bytes], spread: bool = False) -> Iterator[tuple[str, int, list[tuple[int, str]]]]:
    """sheet, row, [(col, value)] of all rows that have cells; rows and columns count from 0, empty and boolean cells are left out.

    ``spread`` repeats a merged range's value in each of its cells; otherwise its first cell has it, as in the file.
    Raises ValueError where the file isn't a workbook.
    """
    try:
        with zipfile.ZipFile(file) as book:
            sheets, late = _sheets(book)
            dates = _dates(book)
            strings = [_text(e) for e in _elements(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in book.namelist() else []
            for title, part in sheets:
                merged = _merged(book, part) if spread else {}
                firsts, held = set(merged.values()), {}
                last = -1
                for e in _elements(book, part, "row"):
                    row, at, cells = int(e.get("r", last + 2)) - 1, -1, {}
                    last = row
                    for c in e:
                        at = _column(c.get("r")) if c.get("r") else at + 1
                        value = _value(c, strings, dates, late)
                        if value is not None:
                            cells[at] = value
                            if (row, at) in firsts:
                                held[row, at] = value
                    for (r, c), first in merged.items():
                        if r == row and first in held:
                            cells.setdefault(c, held[first])
                    if cells:
                        yield title, row, sorted(cells.items())
    except (zipfile.BadZipFile, KeyError, ParseError, IndexError) as error:
        raise ValueError(f"not a workbook: {error!r}") from error
