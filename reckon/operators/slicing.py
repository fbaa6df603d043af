"""Time slices of bounded size, the rows that fall into them, and the account of whether they cover
everything.

The histogram by minute is one aggregation; days, hours and minutes are rolled up from it. Packing
goes over the segments in order of time with one running sum that starts anew at each cut: a fold
over the histogram, not over rows. The first grain's segments (a row for each day, say) are packed on
the driver; finer segments are packed by executors, for each segment that was over by itself, so in
groups of at most 24 hours or 60 minutes.

Rows meet slices by equality: slices are made of whole segments, so each minute is looked up by its
day, hour and minute among the segments of the slices of that grain.
"""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.functions.names import fresh, quoted
from reckon.operators import ranks
from reckon.ship import ship
from reckon.store import keep

GRAINS = ("day", "hour", "minute")
_LENGTH = {"day": "INTERVAL 1 DAY", "hour": "INTERVAL 1 HOUR", "minute": "INTERVAL 1 MINUTE"}
SLICE_SCHEMA = "slice int, grain string, start timestamp_ntz, end timestamp_ntz, n long, over boolean"


def segment_end(start: str, grain: str):
    """The last microsecond of a segment, as a column."""
    return F.expr(f"{start} + {_LENGTH[grain]} - INTERVAL 1 MICROSECOND")


def pack(segments: list[tuple[object, int]], batch: int) -> list[tuple[object, object, int, bool]]:
    """(first segment, last segment, rows, over) of slices of up to `batch` rows; a segment with more
    is a slice of its own, marked over; segments without rows are passed by."""
    out, open_slice = [], None
    for at, n in segments:
        if n <= 0:
            continue
        if n > batch:
            out += [open_slice] if open_slice else []
            out.append((at, at, n, True))
            open_slice = None
        elif open_slice and open_slice[2] + n <= batch:
            open_slice = (open_slice[0], at, open_slice[2] + n, False)
        else:
            out += [open_slice] if open_slice else []
            open_slice = (at, at, n, False)
    return out + ([open_slice] if open_slice else [])


def _minutes(df: DataFrame, column: str, grain: str = "minute") -> DataFrame:
    """t (null for rows without a time) and n."""
    return df.groupBy(F.date_trunc(grain, quoted(column)).cast("timestamp_ntz").alias("t")).agg(F.count("*").alias("n"))


_SPAN = {"day": timedelta(days=1), "hour": timedelta(hours=1), "minute": timedelta(minutes=1)}
_MICRO = timedelta(microseconds=1)
_PARTS = "grain string, start timestamp_ntz, end timestamp_ntz, n long, over boolean"


def _packer(grain: str, batch: int):
    """A function that packs the segments (t, n) of one group."""

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("t")
        return pd.DataFrame([(grain, a, z + _SPAN[grain] - _MICRO, n, over) for a, z, n, over in pack(list(zip(own["t"], own["n"])), batch)], columns=["grain", "start", "end", "n", "over"])

    return cut


def plan(df: DataFrame, column: str, batch: int, grains: tuple[str, ...] = GRAINS) -> DataFrame:
    """Slices of df's rows by time, numbered in its order. Days over the batch are cut by hour, those
    by minute, as far as grains goes; what is still over is marked."""
    spark = df.sparkSession
    finest = _minutes(df, column, grains[-1]).where("t is not null")
    finest = keep(finest, "histogram") if len(grains) > 1 else finest
    of = lambda grain: finest.groupBy(F.date_trunc(grain, "t").cast("timestamp_ntz").alias("t")).agg(F.sum("n").alias("n"))
    first = [(grains[0], a, z + _SPAN[grains[0]] - _MICRO, n, over) for a, z, n, over in pack([(r["t"], r["n"]) for r in of(grains[0]).orderBy("t").toLocalIterator()], batch)]
    if len(grains) == 1 or not any(over for *_, over in first):
        return spark.createDataFrame([(k, *s) for k, s in enumerate(first)], SLICE_SCHEMA)
    ship(spark)
    level, done = spark.createDataFrame(first, _PARTS), []
    for coarse, grain in zip(grains, grains[1:]):
        done.append(level.where("not over"))
        parents = level.where("over").select(F.col("start").alias("parent"))

        inside = of(grain).withColumn("parent", F.date_trunc(coarse, "t").cast("timestamp_ntz")).join(parents, "parent", "left_semi")
        level = keep(inside.groupBy("parent").applyInPandas(_packer(grain, batch), _PARTS), "slices")
    for part in (*done[1:], level):
        done[0] = done[0].union(part)
    numbered = ranks.running_counts(done[0].withColumns({"_g": F.lit(0), "_one": F.lit(1)}), ["_g"], ["start"], "_one")
    return numbered.select(F.col("before").cast("int").alias("slice"), "grain", "start", "end", "n", "over")


def _placed(minutes: DataFrame, slices: DataFrame) -> DataFrame:
    """minutes (t, ...) with the slice that each falls into; those outside all slices are left out."""
    segments = None
    for grain in GRAINS:
        own = slices.where(F.col("grain") == grain).select("slice", F.lit(grain).alias("grain"), F.explode(F.expr(f"sequence(start, end, {_LENGTH[grain]})")).alias("segment"))
        segments = own if segments is None else segments.union(own)
    keys = F.array(*[F.struct(F.lit(g).alias("grain"), F.date_trunc(g, "t").cast("timestamp_ntz").alias("segment")) for g in GRAINS])
    return minutes.where("t is not null").withColumn("at", F.explode(keys)).select("*", "at.grain", "at.segment").drop("at").join(segments, ["grain", "segment"]).drop("grain", "segment")


def fetch(df: DataFrame, column: str, slices: DataFrame, name: str = "slice") -> DataFrame:
    """The rows of df that fall into slices (as plan makes them), with the number of their slice (as
    `name`, or with underscores before it if df has such a column): all slices in one scan, in place of
    one query for each. Rows without a time are in none, and come with a null; rows whose time is
    outside all slices are left out."""
    name, minute = fresh(df, name, "minute")
    at = _placed(_minutes(df, column).select("t"), slices).select(F.col("t").alias(minute), F.col("slice").alias(name))
    timed = df.where(quoted(column).isNotNull()).join(at, F.date_trunc("minute", quoted(column)).cast("timestamp_ntz") == F.col(minute)).drop(minute)
    return timed.union(df.where(quoted(column).isNull()).withColumn(name, F.lit(None).cast("int")))


def audit(df: DataFrame, column: str, slices: DataFrame) -> DataFrame:
    """total (rows of df), planned, fetched (rows that fall into slices), still_over, mismatched
    slices, issues (codes, comma-joined) and complete, in one row. df's rows are counted by minute
    once; slices are as plan makes them."""
    minutes = keep(_minutes(df, column), "minutes")
    got = _placed(minutes, slices).groupBy("slice").agg(F.sum("n").alias("got"))
    met = slices.join(got, "slice", "left")
    one = met.agg(
        F.sum("n").cast("long").alias("planned"), F.sum(F.coalesce("got", F.lit(0))).cast("long").alias("fetched"),
        F.count_if("over").alias("still_over"), F.count_if(F.coalesce("got", F.lit(0)) != F.col("n")).alias("mismatched"),
    )
    one = minutes.agg(F.sum("n").alias("total")).join(one, how="cross").na.fill(0)  # one row by one row
    issue = F.array(
        F.when(F.col("planned") != F.col("total"), "plan_not_total"), F.when(F.col("still_over") > 0, "slices_over"),
        F.when(F.col("mismatched") > 0, "slice_mismatch"), F.when(F.col("fetched") != F.col("total"), "fetched_not_total"),
    )
    return one.withColumn("issues", F.array_join(F.filter(issue, lambda x: x.isNotNull()), ",")).withColumn("complete", F.col("issues") == "")
