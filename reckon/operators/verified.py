"""Rows fetched by time slices, with an account of whether all came.

A plan of slices is made from a histogram of the source first. Then the rows are read slice by slice
into the shared folder, and counted while they are read: what arrived of each slice is held against
the plan, so rows that a source loses (a statement that is cut off, a replica that lags, a table that
changes meanwhile) are told of, slice by slice. Comparisons read what was kept, so the account is of the
rows compared. Rows without a time are a slice of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reckon.functions.names import fresh, quoted
from reckon.operators import slicing
from reckon.sources import jdbc
from reckon.store import keep

#: The slice of rows without a time.
UNTIMED = -1


class Source(Protocol):
    """What can be fetched by slices."""

    def times(self, column: str) -> DataFrame:
        """A table of one column, t: the time of each row (timestamp or null)."""

    def rows(self, column: str, slices: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of slices, kept, and how many came of each (slice, got)."""


@dataclass
class Frame:
    """A DataFrame (files, tables, a query). All slices are read in one scan."""

    df: DataFrame

    def _time(self, column: str):
        c = quoted(column)
        if dict(self.df.dtypes)[column] == "string":  # yyyyMMdd, or whatever Spark reads as a time
            c = F.coalesce(F.try_to_timestamp(c), F.try_to_date(c, "yyyyMMdd").cast("timestamp"))
        return c.cast("timestamp_ntz")

    def times(self, column: str) -> DataFrame:
        return self.df.select(self._time(column).alias("t"))

    def rows(self, column: str, slices: DataFrame) -> tuple[DataFrame, DataFrame]:
        at, part = fresh(self.df, "at", "slice")
        read = slicing.fetch(self.df.withColumn(at, self._time(column)), at, slices.where("start IS NOT NULL"), part)
        kept = keep(read.drop(at), "fetched")
        got = kept.groupBy(F.coalesce(quoted(part), F.lit(UNTIMED)).alias("slice")).agg(F.count("*").alias("got"))
        return kept.drop(part), got


@dataclass
class Table:
    """A table of a database. Each slice is a statement of its own and a partition of the scan, so many
    are read at once, and a lost executor costs its slices only. One predicate a slice comes from the
    driver. What arrives is counted by an observation of the scan itself."""

    spark: SparkSession
    connection: jdbc.Connection
    name: str
    cluster: str = ""
    db: str = ""

    def times(self, column: str) -> DataFrame:
        return jdbc.table(self.spark, self.connection, self.name, self.cluster, self.db).select(quoted(column).cast("timestamp_ntz").alias("t"))

    def rows(self, column: str, slices: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = slices.select("slice", "start", "end").orderBy("slice").collect()
        name = jdbc.quoted(self.spark, self.connection.url, column)
        read = jdbc.table(self.spark, self.connection, self.name, self.cluster, self.db, [predicate(name, r["start"], r["end"]) for r in own])
        if not own:
            return keep(read.limit(0), "fetched"), slices.select("slice", F.lit(0).cast("long").alias("got")).limit(0)
        (part,) = fresh(read, "part")
        seen = Observation()
        # the n-th partition is the n-th slice; with a bin for each value, the histogram is exact
        counted = read.withColumn(part, F.spark_partition_id()).observe(seen, F.histogram_numeric(part, F.lit(len(own) + 1)).alias("by_part"))
        kept = keep(counted.drop(part), "fetched")
        got = [(own[int(x["x"])]["slice"], int(x["y"])) for x in seen.get["by_part"] or []]
        return kept, self.spark.createDataFrame(got, "slice int, got long")


def predicate(column: str, start, end) -> str:
    """A slice's condition, with times as JDBC writes them in any dialect."""
    if start is None:
        return f"{column} IS NULL"
    stamp = lambda t: "{ts '" + t.strftime("%Y-%m-%d %H:%M:%S.%f") + "'}"
    return f"{column} >= {stamp(start)} AND {column} <= {stamp(end)}"


@dataclass
class Fetched:
    """rows: those that came; slices: slice, start, end, n (planned) and got; account: one row, in which
    mismatched counts slices, and gaps the stretches of adjacent slices among these. How many slices
    an hour is cut into depends on how many rows it has; a stretch that loses rows stays one gap."""

    rows: DataFrame
    slices: DataFrame
    account: DataFrame

    @property
    def issues(self) -> list[str]:
        """Codes of what is amiss; slices that can't be cut smaller are read whole, so they aren't."""
        return [x for x in self.account.first()["issues"].split(",") if x and x != "slices_over"]


def fetch(source: Source, column: str, batch: int, grains: tuple[str, ...] = slicing.GRAINS) -> Fetched:
    """All rows of a source, by slices of up to batch rows as far as grains can cut them."""
    times = source.times(column)
    untimed = times.where("t IS NULL").agg(F.lit(UNTIMED).alias("slice"), F.lit("none").alias("grain"), F.lit(None).cast("timestamp_ntz").alias("start"), F.lit(None).cast("timestamp_ntz").alias("end"), F.count("*").alias("n"), F.lit(False).alias("over")).where("n > 0")
    planned = keep(slicing.plan(times, "t", batch, grains).union(untimed), "planned")
    rows, got = source.rows(column, planned)
    met = keep(planned.join(got, "slice", "full_outer").withColumns({"n": F.coalesce("n", F.lit(0)), "got": F.coalesce("got", F.lit(0))}), "account")
    bad = met.where("n <> got").select("slice")
    after = bad.where(F.col("slice") != UNTIMED).select((F.col("slice") + 1).alias("slice"))
    gaps = bad.join(after, "slice", "left_anti").agg(F.count("*").alias("gaps"))  # the first slice of each
    one = met.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name) for c, name in (("n", "planned"), ("got", "fetched"))],
        F.count_if(F.coalesce("over", F.lit(False))).alias("still_over"), F.count_if(F.col("n") != F.col("got")).alias("mismatched"),
    )
    issue = F.array(F.when(F.col("still_over") > 0, "slices_over"), F.when(F.col("mismatched") > 0, "slice_mismatch"), F.when(F.col("planned") != F.col("fetched"), "fetched_not_planned"))
    one = one.withColumn("issues", F.array_join(F.filter(issue, lambda x: x.isNotNull()), ",")).withColumn("complete", F.col("mismatched") == 0).join(gaps, how="cross")  # one row each
    return Fetched(rows, met, one)
