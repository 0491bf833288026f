"""Zipped sheets (xlsx): their rows as texts, read and written inside tasks."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import date, datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: The built-in number formats that are dates or times, and the day that serial numbers count from.
DATE_FORMATS, EPOCH = {*range(14, 23), *range(45, 48)}, datetime(1899, 12, 30)
_LETTERS = re.compile(r"\[[^\]]*\]|\"[^\"]*\"|\\.")


def _part(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    """Which cell styles show a number as a date: by built-in format, or by letters of dates in an own one."""
    styles = _part(book, "xl/styles.xml")
    if styles is None:
        return []
    own = {int(f.get("numFmtId")): bool(re.search("[ymdhs]", _LETTERS.sub("", f.get("formatCode", "")).lower())) for f in styles.iter(f"{_NS}numFmt")}
    cells = styles.find(f"{_NS}cellXfs")
    return [own.get(i, i in DATE_FORMATS) for i in (int(x.get("numFmtId", 0)) for x in (cells if cells is not None else []))]


def _number(text: str, as_date: bool) -> str:
    value = float(text)
    if as_date:
        at = EPOCH + timedelta(seconds=round(value * 86400))
        return at.strftime("%Y-%m-%d") if at.time() == datetime.min.time() else at.strftime("%H:%M:%S" if value < 1 else "%Y-%m-%d %H:%M:%S")
    return str(int(value)) if value.is_integer() else repr(value)


def _column(reference: str) -> int:
    place = 0
    for letter in reference.rstrip("0123456789"):
        place = place * 26 + ord(letter.upper()) - 64
    return place - 1


def sheet_rows(content: bytes):
    """(sheet number, sheet name, row number, cells) of a workbook, row by row; empty rows are left out.

    Shared and inline strings are texts; numbers are written plainly, those in a date style as ISO date or time. Rows and
    cells keep their places: a cell that isn't there is None.
    """
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = _part(book, "xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in (shared if shared is not None else [])]
    dates, targets = _date_styles(book), {r.get("Id"): r.get("Target") for r in _part(book, "xl/_rels/workbook.xml.rels")}
    for number, sheet in enumerate(_part(book, "xl/workbook.xml").iter(f"{_NS}sheet")):
        target = targets[sheet.get(_REL)].lstrip("/")
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as part:
            at = -1
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{_NS}row":
                    continue
                at, cells = int(row.get("r", at + 2)) - 1, []
                for cell in row.iter(f"{_NS}c"):
                    place = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (place + 1 - len(cells))
                    value, kind = cell.findtext(f"{_NS}v"), cell.get("t", "n")
                    if kind == "inlineStr":
                        cells[place] = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                    elif value is not None:
                        style = int(cell.get("s", 0))
                        cells[place] = strings[int(value)] if kind == "s" else _number(value, style < len(dates) and dates[style]) if kind == "n" else value
                row.clear()
                if any(c not in (None, "") for c in cells):
                    yield number, sheet.get("name"), at, cells


def workbook_rows(files: DataFrame) -> DataFrame:
    """(file, sheet_no, sheet, row_no, cells) of the workbooks among `files` (path, content); a file that can't be read gives one row with `problem`.

    A workbook is parsed in the task that holds it, and its rows leave in batches.
    """
    fields = {"file": pa.string(), "sheet_no": pa.int32(), "sheet": pa.string(), "row_no": pa.int32(), "cells": pa.list_(pa.string()), "problem": pa.string()}

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                try:
                    for number, name, at, cells in sheet_rows(content.as_py()):
                        rows.append((path, number, name, at, cells, None))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), fields.values(), strict=True)], names=list(fields))
                            rows = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, TypeError) as e:
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), fields.values(), strict=True)], names=list(fields))

    return files.select("path", "content").mapInArrow(read, "file string, sheet_no int, sheet string, row_no int, cells array<string>, problem string")


_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{}</Types>'
_STYLES = f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{_NS[1:-1]}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def _letters(place: int) -> str:
    out, place = "", place + 1
    while place:
        place, rest = divmod(place - 1, 26)
        out = chr(65 + rest) + out
    return out


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of the sheets' rows. Dates become serial numbers in a date style, numbers numbers, None nothing, the rest texts."""
    parts = {}
    for number, rows in enumerate(sheets.values(), 1):
        lines = []
        for r, row in enumerate(rows, 1):
            cells = []
            for c, value in enumerate(row):
                at = f'r="{_letters(c)}{r}"'
                if isinstance(value, date):
                    cells.append(f'<c {at} s="1"><v>{(value - EPOCH.date()).days}</v></c>')
                elif isinstance(value, (int, float)) and not isinstance(value, bool):
                    cells.append(f"<c {at}><v>{value!r}</v></c>")
                elif value is not None:
                    cells.append(f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>')
            lines.append(f'<row r="{r}">{"".join(cells)}</row>')
        parts[f"xl/worksheets/sheet{number}.xml"] = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>'
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    listed = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, name in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS[1:-1]}" xmlns:r="{kind}"><sheets>{listed}</sheets></workbook>'
    links = "".join(f'<Relationship Id="r{i}" Type="{kind}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    parts["xl/_rels/workbook.xml.rels"] = _RELS.format(links + f'<Relationship Id="s" Type="{kind}/styles" Target="styles.xml"/>')
    parts["xl/styles.xml"] = _STYLES
    parts["_rels/.rels"] = _RELS.format(f'<Relationship Id="b" Type="{kind}/officeDocument" Target="xl/workbook.xml"/>')
    own = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in {"[Content_Types].xml": _TYPES.format(own), **parts}.items():
            book.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()
