"""Workbooks and CSV files for people: typed cells, no active formulas, headers that stay in view.

`write_workbook` makes one file, by the driver, from a row iterator, sheet by sheet, so only one
partition's rows are held at a time; SHEET_ROWS bounds a sheet, and what is beyond is told, not lost
silently, or goes to further sheets. `write_workbooks` makes many, by executors.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime
from itertools import chain, islice
from pathlib import Path
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.functions.export import cell_kind, escaped
from reckon.functions.names import quoted
from reckon.ship import ship

SHEET_ROWS = 50_000
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
_TYPES = "http://schemas.openxmlformats.org"


def safe_name(name: str) -> str:
    """A file name of word characters, 80 at most."""
    return re.sub(r"[^\w.-]+", "_", name)[:80] or "file"


def _letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


class _Styles:
    """Cell styles by number format; 0 is plain, 1 the header."""

    def __init__(self) -> None:
        self.formats: list[str] = []

    def of(self, fmt: str | None) -> int:
        if not fmt:
            return 0
        if fmt not in self.formats:
            self.formats.append(fmt)
        return 2 + self.formats.index(fmt)

    def xml(self) -> str:
        formats = "".join(f'<numFmt numFmtId="{164 + i}" formatCode="{escape(f, {chr(34): "&quot;"})}"/>' for i, f in enumerate(self.formats))
        cells = "".join(f'<xf numFmtId="{49 if f == "@" else 164 + i}" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/>' for i, f in enumerate(self.formats))
        return (
            f'<styleSheet xmlns="{_TYPES}/spreadsheetml/2006/main"><numFmts count="{len(self.formats)}">{formats}</numFmts>'
            '<fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/></font></fonts>'
            '<fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills>'
            '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
            f'<cellXfs count="{2 + len(self.formats)}"><xf/><xf fontId="1" applyFont="1"/>{cells}</cellXfs></styleSheet>'
        )


def _cell(at: str, kind: str, text: str, style: int) -> str:
    s = f' s="{style}"' if style else ""
    if kind in ("number", "percent"):
        value = repr(float(text) / 100) if kind == "percent" else text
        return f'<c r="{at}"{s}><v>{value}</v></c>'
    if kind in ("date", "datetime"):
        days = (datetime.fromisoformat(text) - datetime(1899, 12, 30)).total_seconds() / 86400
        return f'<c r="{at}"{s}><v>{int(days) if days == int(days) else repr(days)}</v></c>'
    return f'<c r="{at}"{s} t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", text))}</t></is></c>' if text else f'<c r="{at}"{s}/>'


def _sheet(names: list[str], rows: Iterable, styles: _Styles) -> Iterable[str]:
    last = _letters(max(0, len(names) - 1))
    yield f'<worksheet xmlns="{_TYPES}/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>'
    yield '<row r="1">' + "".join(_cell(f"{_letters(k)}1", "text", n, 1) for k, n in enumerate(names)) + "</row>"
    n = 1
    for n, row in enumerate(rows, 2):
        cells = "".join(_cell(f"{_letters(k)}{n}", c["kind"], c["text"] or "", styles.of(c["format"])) for k, c in enumerate(row))
        yield f'<row r="{n}">{cells}</row>'
    yield f'</sheetData><autoFilter ref="A1:{last}{n}"/></worksheet>'


def _parts(rows: Iterable, most: int) -> Iterable[Iterable]:
    """The rows of each sheet of a table: of a first one always, of further ones while there are rows.
    Each is to be used up before the next."""
    rows = iter(rows)
    yield islice(rows, most)
    while (first := next(rows, None)) is not None:
        yield chain([first], islice(rows, most - 1))


#: Fixed value: the title of the sheet that tells which sheets don't have all their rows.
CUT = "截断说明"


def _cut_rows(told: dict[str, tuple[int, int]]) -> list[list[dict]]:
    cell = lambda kind, text: {"kind": kind, "text": text, "format": None}
    return [[cell("text", title), cell("number", str(n)), cell("number", str(total)), cell("text", f"{n}/{total}")] for title, (n, total) in told.items() if n < total]


def _finish(z: zipfile.ZipFile, titles: list[str], styles: _Styles) -> None:
    """The parts of a workbook beside its sheets."""
    z.writestr("xl/styles.xml", styles.xml())
    z.writestr("xl/workbook.xml", f'<workbook xmlns="{_TYPES}/spreadsheetml/2006/main" xmlns:r="{_TYPES}/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, t in enumerate(titles, 1)) + "</sheets></workbook>")
    rel = f"{_TYPES}/officeDocument/2006/relationships"
    z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_TYPES}/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(titles) + 1)) + f'<Relationship Id="rId{len(titles) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
    z.writestr("_rels/.rels", f'<Relationships xmlns="{_TYPES}/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    z.writestr("[Content_Types].xml", f'<Types xmlns="{_TYPES}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{main}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{main}.worksheet+xml"/>' for i in range(1, len(titles) + 1)) + "</Types>")


def write_workbook(path: str, sheets: dict[str, DataFrame], most: int = SHEET_ROWS, split: bool = False) -> dict[str, tuple[int, int]]:
    """Writes each table to a sheet, in the order given; returns (written, total) rows of each. With
    split, rows beyond most go to further sheets ("title (2)", ...), so all are written; else they are
    left out, and a last sheet in the file tells of which sheets, and how many of how many there are."""
    styles, told = _Styles(), {}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        titles = []
        for title, df in sheets.items():
            name = re.sub(r"[\[\]:*?/\\]", "_", title)
            typed = (df if split else df.limit(most)).select(*[cell_kind(quoted(c).cast("string"), c).alias(f"c{k}") for k, c in enumerate(df.columns)])
            total = df.count()
            told[title] = (total if split else min(total, most), total)
            for k, rows in enumerate(_parts(typed.toLocalIterator(), most), 1):
                more = f" ({k})" if k > 1 else ""
                titles.append(name[: 31 - len(more)] + more)
                with z.open(f"xl/worksheets/sheet{len(titles)}.xml", "w") as out:
                    for part in _sheet(df.columns, rows, styles):
                        out.write(part.encode())
        if cut := _cut_rows(told):
            titles.append(CUT)
            with z.open(f"xl/worksheets/sheet{len(titles)}.xml", "w") as out:
                for part in _sheet(["sheet", "written", "total", "rows"], cut, styles):
                    out.write(part.encode())
        _finish(z, titles, styles)
    return told


def write_workbooks(df: DataFrame, path: str, order: list[str], most: int = SHEET_ROWS) -> int:
    """df as workbooks of about most rows below path (part-00000.xlsx, ...), each with the rows of one
    range of the columns `order`, sorted; returns how many rows. Executors write them, one for each task,
    so nothing passes through the driver. path must be of a file system that Arrow knows (file, hdfs, s3,
    gs, abfs)."""
    n = max(1, -(-df.count() // most))
    sorts, names = [f"o{k}" for k in range(len(order))], df.columns
    typed = df.select(*[cell_kind(quoted(c).cast("string"), c).alias(f"c{k}") for k, c in enumerate(names)], *[quoted(c).alias(s) for c, s in zip(order, sorts)])
    ranged = typed.repartitionByRange(n, *sorts).sortWithinPartitions(*sorts).drop(*sorts)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))
        part, styles, told = TaskContext.get().partitionId(), _Styles(), 0

        def rows() -> Iterator[tuple]:
            nonlocal told
            for b in batches:
                for row in zip(*(b.column(k).to_pylist() for k in range(len(names)))):
                    told += 1
                    yield row

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
                for text in _sheet(names, rows(), styles):
                    sheet.write(text.encode())
            _finish(z, ["rows"], styles)
        # another attempt of the task writes the same file again
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/part-{part:05}.xlsx") as f:
            f.write(out.getvalue())
        yield pa.RecordBatch.from_pydict({"rows": pa.array([told], pa.int64())})

    ship(df.sparkSession)
    return ranged.mapInArrow(write, "rows long").agg(F.sum("rows")).first()[0] or 0


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files below path with escaped cells, nulls as empty fields, and a byte order mark before
    each header, so that spreadsheets take them for UTF-8. Written by Spark's own writer."""
    cells = [escaped(F.coalesce(quoted(c).cast("string"), F.lit(""))) for c in df.columns]
    names = [("'" + c) if re.match(r"\s*[=+\-@]|[\t\r\n]", c) else c for c in df.columns]
    names[0] = "﻿" + names[0]
    df.select(*[x.alias(n) for x, n in zip(cells, names)]).write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def artifacts(folder: str, most: int = 60) -> list[tuple[str, int, float]]:
    """(name, bytes, time) of the newest result files of a folder, of known kinds."""
    kinds = {".xlsx", ".csv", ".sql", ".pdf", ".docx", ".txt"}
    found = [p for p in Path(folder).iterdir() if p.is_file() and p.suffix.lower() in kinds]
    return [(p.name, p.stat().st_size, p.stat().st_mtime) for p in sorted(found, key=lambda p: -p.stat().st_mtime)[:most]]


def within(folder: str, name: str) -> Path:
    """The path of a file by name, which must lie in the folder."""
    root = Path(folder).resolve()
    path = (root / name).resolve()
    if root not in path.parents:
        raise ValueError("a path outside the folder")
    return path
