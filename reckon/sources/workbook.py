"""Workbooks (OOXML) read with the standard library: sheets, header rows, formulas without values.

A workbook is one archive, read as a whole by the driver, whose memory bounds its size (a format for
people's tables, of a million rows a sheet at most). A sheet's declared dimension isn't looked at, so
a wrong one does no harm.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from reckon.ship import ship

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows of a sheet that are looked at to choose among sheets.
LOOK = 200
# Built-in number formats of dates and times.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


@dataclass
class Sheet:
    name: str
    grid: list[list[str | None]] = field(default_factory=list)
    formulas: int = 0

    @property
    def filled(self) -> int:
        return sum(_filled(r) for r in self.grid[:LOOK])


def _filled(row: list[str | None]) -> int:
    return sum(v is not None and v.strip() != "" for v in row)


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Indices of cell styles that show dates or times."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    dates = set(_DATE_FORMATS)
    for f in root.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", ""))
        if re.search(r"[ymdhs]", code, re.I) and "#" not in code and "0.0" not in code:
            dates.add(int(f.get("numFmtId")))
    formats = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId", 0)) in dates}


def _date(serial: float) -> str:
    at = datetime(1899, 12, 30) + timedelta(seconds=round(serial * 86400))
    if serial < 1:
        return f"{at:%H:%M:%S}"
    return f"{at:%Y-%m-%d}" if serial == int(serial) else f"{at:%Y-%m-%d %H:%M:%S}"


def _text_of(node) -> str:
    """The text below a node, in runs or not, without phonetic readings."""
    if node.tag == f"{_MAIN}rPh":
        return ""
    own = node.text or "" if node.tag == f"{_MAIN}t" else ""
    return own + "".join(map(_text_of, node))


def sheets(data: bytes) -> list[Sheet]:
    """All sheets with their grids of text: numbers plain, dates as ISO, booleans TRUE and FALSE,
    formulas without a stored value as their text."""
    return list(each_sheet(data))


def each_sheet(data: bytes) -> Iterator[Sheet]:
    """The sheets one after the other, for those who need not hold them all."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = [_text_of(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    dates = _date_styles(z)
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = targets[s.get(f"{_REL}id")]
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        sheet = Sheet(s.get("name"))
        for _, row in ElementTree.iterparse(z.open(path)):
            if row.tag != f"{_MAIN}row":
                continue
            at = int(row.get("r", len(sheet.grid) + 1))
            sheet.grid += [[] for _ in range(at - 1 - len(sheet.grid))]
            cells: list[str | None] = []
            for c in row:
                k = _column(c.get("r", "")) if c.get("r") else len(cells)
                cells += [None] * (k + 1 - len(cells))
                cells[k] = _value(c, shared, dates, sheet)
            sheet.grid.append(cells)
            row.clear()
        yield sheet


def _value(c, shared: list[str], dates: set[int], sheet: Sheet) -> str | None:
    kind, v, f = c.get("t"), c.find(f"{_MAIN}v"), c.find(f"{_MAIN}f")
    if kind == "inlineStr":
        return _text_of(c)
    if v is None or v.text is None:
        if f is not None and f.text:
            sheet.formulas += 1
            return "=" + f.text
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "TRUE" if v.text == "1" else "FALSE"
    if kind in ("str", "e", "d"):
        return v.text
    number = float(v.text)
    if int(c.get("s", 0)) in dates:
        return _date(number)
    return str(int(number)) if number == int(number) and abs(number) < 1e15 else v.text


def header_row(grid: list[list[str | None]]) -> int:
    """The first row that is half as full as the fullest (two cells at least, if there are so many)."""
    widths = [_filled(r) for r in grid]
    most = max(widths, default=0)
    for i, w in enumerate(widths):
        if w and w >= min(2, most) and w * 2 >= most:
            return i
    return 0


def table_of(sheet: Sheet) -> tuple[list[str], list[tuple[int, list[str | None]]]]:
    """Header names and (row number, cells) of a sheet; blank rows, and unnamed empty columns at the
    end, are left out."""
    if not sheet.grid:
        return [], []
    at = header_row(sheet.grid)
    names = [v.strip() if v and v.strip() else None for v in sheet.grid[at]]
    below = [(i + 1, r) for i, r in enumerate(sheet.grid) if i > at and _filled(r)]
    while names and names[-1] is None and not any(len(r) >= len(names) and r[len(names) - 1] for _, r in below):
        names.pop()
    headers = [n or f"列{i}" for i, n in enumerate(names, 1)]
    return headers, [(i, (r + [None] * len(headers))[: len(headers)]) for i, r in below]


def pick(found: list[Sheet]) -> int:
    """The sheet with most filled cells among its first rows, the first of equals."""
    return max(range(len(found)), key=lambda i: (found[i].filled, -i), default=0)


def _bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> tuple[DataFrame, dict]:
    """A sheet (by name, or the fullest) as a table of text with _row, and what was noticed: sheet,
    sheets, header_row and formula_cells."""
    found = sheets(_bytes(spark, path))
    if not found:
        raise ValueError("a workbook without sheets")
    names = [s.name for s in found]
    own = found[names.index(sheet) if sheet is not None else pick(found)]
    headers, rows = table_of(own)
    schema = "_row int" + "".join(f", `c{i}` string" for i in range(len(headers)))
    df = spark.createDataFrame([(i, *r) for i, r in rows], schema).toDF("_row", *headers)
    meta = {"sheet": own.name, "sheets": [(s.name, len(s.grid), max(map(len, s.grid), default=0), s.filled) for s in found], "header_row": header_row(own.grid) + 1 if own.grid else 0, "formula_cells": own.formulas}
    return df, meta


def list_sheets(spark: SparkSession, path: str) -> DataFrame:
    """name, rows, cols and filled of each sheet."""
    found = sheets(_bytes(spark, path))
    return spark.createDataFrame([(s.name, len(s.grid), max(map(len, s.grid), default=0), s.filled) for s in found], "name string, rows int, cols int, filled int")


def read_workbooks(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The rows of all workbooks below path as text, by executors, a file at a time: of each sheet those
    of the columns that it has, null for others. Blank rows are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                for sheet in each_sheet(data):
                    headers, rows = table_of(sheet)
                    at = [headers.index(c) if c in headers else None for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array([None if k is None else r[k] for _, r in rows], pa.string()) for k in at], names=[f"c{k}" for k in range(len(columns))])

    ship(spark)
    return files.mapInArrow(read, ", ".join(f"c{k} string" for k in range(len(columns)))).toDF(*columns)
