"""Delimited files and pasted text, as tables of text with the place of each row."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.ship import ship

# Encodings tried in this order.
ENCODINGS = ("utf-8-sig", "utf-8", "gbk", "gb2312", "gb18030", "latin-1")
#: Those that Spark's own reader takes; files in others are decoded by a Python worker, one task a file.
_SPARK_NAMES = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "latin-1": "ISO-8859-1"}
_SNIFF_BYTES = 1 << 20


class ReadError(ValueError):
    """A file that can't be read as a table."""


def _head(spark: SparkSession, path: str, n: int = _SNIFF_BYTES) -> bytes:
    """The first bytes of a file in any store that Spark reads."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def encoding_of(raw: bytes) -> str:
    """The first encoding that reads the bytes; a character cut at their end doesn't count."""
    for name in ENCODINGS:
        if name == "utf-8-sig" and not raw.startswith(b"\xef\xbb\xbf"):
            continue
        for cut in range(4):
            try:
                raw[: len(raw) - cut].decode(name)
                return name
            except UnicodeDecodeError:
                continue
    return "latin-1"


def separator_of(text: str) -> str:
    """Tab or comma: tab only if the first ten lines have more of them."""
    head = text.splitlines()[:10]
    return "\t" if sum(x.count("\t") for x in head) > sum(x.count(",") for x in head) else ","


def read_delimited(spark: SparkSession, path: str, separator: str = "") -> DataFrame:
    """A delimited file with a header: every column text, stripped header names, empty fields as ''.

    Nothing is inferred, and NULL stays a word; rows are those of the file, in any order."""
    raw = _head(spark, path)
    name = encoding_of(raw)
    head = raw.decode(name, "ignore").lstrip("﻿")
    separator = separator or separator_of(head)
    first = next(csv.reader(io.StringIO(head), delimiter=separator), None)
    if not first:
        raise ReadError("the file is empty")
    names = [x.strip() for x in first]
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    if name not in _SPARK_NAMES:
        return _decoded(spark, path, name, separator, len(names), schema).toDF(*names)
    df = (
        spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", separator).option("encoding", _SPARK_NAMES[name]).option("multiLine", True)
        .option("quote", '"').option("escape", '"').option("nullValue", "\x00").option("emptyValue", "").option("mode", "PERMISSIVE").csv(path)
    )
    return df.select(*[F.coalesce(F.col(f"c{i}"), F.lit("")).alias(f"c{i}") for i in range(len(names))]).toDF(*names)


def _decoded(spark: SparkSession, path: str, encoding: str, separator: str, width: int, schema: str) -> DataFrame:
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                lines = csv.reader(io.TextIOWrapper(io.BytesIO(data.as_py()), encoding, "replace", newline=""), delimiter=separator)
                next(lines, None)
                while rows := [(r + [""] * width)[:width] for r in islice(lines, 10_000) if r]:
                    yield pa.RecordBatch.from_pydict({f"c{i}": pa.array([r[i] for r in rows], pa.string()) for i in range(width)})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A file by its ending: xlsx and xlsm workbooks, csv with commas, txt and tsv by content."""
    from reckon.sources.workbook import read_sheet

    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("xlsx", "xlsm"):
        return read_sheet(spark, path, sheet)[0]
    if ending == "csv":
        return read_delimited(spark, path, ",")
    if ending in ("txt", "tsv"):
        return read_delimited(spark, path)
    raise ReadError(f"no reader for .{ending} files")


# -- pasted text -----------------------------------------------------------------------------------


def delimiter_of(line: str) -> str:
    """Tab, then pipe, then comma, then two or more blanks."""
    for d in ("\t", "|", ","):
        if d in line:
            return d
    return "  " if re.search(r"\S {2,}\S", line) else ","


def text_rows(text: str, delimiter: str = "auto") -> list[list[str]]:
    """Rows of stripped cells, padded to the widest; blank rows inside stay, those around go."""
    text = text.lstrip("﻿")
    lines = text.splitlines()
    while lines and not lines[0].strip():
        lines.pop(0)
    while lines and not lines[-1].strip():
        lines.pop()
    if not lines:
        return []
    delimiter = delimiter_of(lines[0]) if delimiter == "auto" else delimiter
    if delimiter.strip(" ") == "":
        rows = [re.split(r" {2,}", x.strip()) if x.strip() else [""] for x in lines]
    else:
        rows = [r or [""] for r in csv.reader(io.StringIO("\n".join(lines)), delimiter=delimiter)]
    widest = max(map(len, rows))
    return [[c.strip() for c in r] + [""] * (widest - len(r)) for r in rows]


def text_table(spark: SparkSession, text: str, delimiter: str = "auto") -> DataFrame:
    """Pasted text with a header row, as a table of text with _row (2 for the first row)."""
    rows = text_rows(text, delimiter)
    if not rows:
        raise ReadError("no text")
    names = [n or f"列{i}" for i, n in enumerate(rows[0], 1)]
    schema = "_row int, " + ", ".join(f"`c{i}` string" for i in range(len(names)))
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows[1:], 2)], schema).toDF("_row", *names)
