"""Reports of differences as workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.operators import keyed_diff, verdicts
from reckon.operators.keyed_diff import KeyedDiff
from reckon.sinks.workbook import write_workbook

# Titles of the report's sheets.
SUMMARY, CELLS, ONLY_A, ONLY_B, LOG = "结论", "字段值差异", "仅A有", "仅B有", "排查日志"


def _summary(verdict: DataFrame, stats: DataFrame) -> DataFrame:
    """item and value rows of a verdict and of statistics, of one row each."""
    rows = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in df.columns])))
    return rows(verdict).union(rows(stats))


def file_report(diff: KeyedDiff, path: str) -> dict[str, tuple[int, int]]:
    """Summary, differing cells and rows of one side only; returns (written, total) of each sheet."""
    stats = diff.stats()
    cells = diff.cells().select("key", "column", "value_a", "value_b", "n").orderBy("key", "column")
    only = [diff.only(s).orderBy("key") for s in "ab"]
    return write_workbook(path, {SUMMARY: _summary(verdicts.file_verdict(stats), stats), CELLS: cells, ONLY_A: only[0], ONLY_B: only[1]})


def sql_report(diff: KeyedDiff, path: str) -> dict[str, tuple[int, int]]:
    """Summary, log and differing cells of a result diff."""
    stats = diff.stats()
    log = keyed_diff.log_rows(diff).orderBy("level", "reason", "key")
    cells = diff.cells().select("key", "column", "value_a", "value_b", "n").orderBy("key", "column")
    return write_workbook(path, {SUMMARY: _summary(verdicts.sql_verdict(stats), stats), LOG: log, CELLS: cells})
