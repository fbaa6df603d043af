"""Tables from recognised text blocks with their places in an image: gaps and islands, by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_TOLERANCE = 0.6
COLUMN_GAP = 0.025
LEAST_FILL = 0.15


def clean(text: Column) -> Column:
    """Stripped text without white space between Chinese characters; null is empty."""
    ends = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(ends, r"(?U)(?<=[㐀-鿿])\s+(?=[㐀-鿿])", "")


def tables(blocks: DataFrame, row_tolerance: float = ROW_TOLERANCE, column_gap: float = COLUMN_GAP, least_fill: float = LEAST_FILL) -> DataFrame:
    """image, row and cells of blocks (image, text, x, y, w, h), image by image.

    In order of their middles, blocks stay in a row until one's middle is further from the one before
    than row_tolerance of the taller of both; in order of their left edges, they stay in a column
    until a step of more than column_gap. Several blocks of a cell are joined from left to right.
    Columns that are filled in less than least_fill of the rows go (but the fullest, if all would),
    then rows without text. Blocks without a place are passed by."""
    placed = blocks.where("x is not null and y is not null and h is not null").select("image", clean(F.col("text")).alias("text"), "x", (F.col("y") + F.col("h") / 2).alias("mid"), "h")

    def islands(order: list[str], gap: Column, allowed: Column) -> Column:
        w = Window.partitionBy("image").orderBy(*order)  # an image's blocks are few
        return F.sum(F.coalesce((gap > allowed).cast("int"), F.lit(0))).over(w)

    before = lambda c, order: F.lag(c).over(Window.partitionBy("image").orderBy(*order))
    down, across = ["mid", "x", "text"], ["x", "mid", "text"]
    steps = placed.withColumns({
        "fall": F.col("mid") - before("mid", down), "tall": F.greatest("h", before("h", down)) * row_tolerance, "step": F.col("x") - before("x", across),
    })
    cells = steps.withColumns({"line": islands(down, F.col("fall"), F.col("tall")), "place": islands(across, F.col("step"), F.lit(column_gap))})
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("x", "mid", "text")))), lambda b: b["text"])
    cells = cells.groupBy("image", "line", "place").agg(F.array_join(parts, " ").alias("text"))
    fill = cells.groupBy("image", "place").agg(F.count_if(F.col("text") != "").alias("filled"))
    lines = cells.groupBy("image").agg(F.countDistinct("line").alias("lines"))
    best = Window.partitionBy("image").orderBy(F.desc("filled"), "place")
    kept = fill.join(lines, "image").withColumn("rank", F.row_number().over(best)).where((F.col("filled") >= F.col("lines") * least_fill) | (F.col("rank") == 1))
    columns = kept.groupBy("image").agg(F.array_sort(F.collect_list("place")).alias("places"))
    texts = cells.where("text <> ''").groupBy("image", "line").agg(F.map_from_entries(F.collect_list(F.struct("place", "text"))).alias("of"))
    rows = texts.join(columns, "image").select("image", "line", F.transform("places", lambda p: F.coalesce(F.element_at("of", p), F.lit(""))).alias("cells"))
    rows = rows.where(F.exists("cells", lambda c: c != ""))
    return rows.select("image", F.row_number().over(Window.partitionBy("image").orderBy("line")).alias("row"), "cells")


def quality(blocks: DataFrame) -> DataFrame:
    """image, blocks, mean_conf (3 decimals; null if a block has none) and low (up to 20 texts below
    0.5, by place) of blocks with conf."""
    sure = F.count("conf") == F.count("*")
    low = F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("conf") < 0.5, F.struct("y", "x", "text")))), lambda b: b["text"]), 1, 20)
    return blocks.groupBy("image").agg(F.count("*").alias("blocks"), F.when(sure, F.round(F.avg("conf"), 3)).alias("mean_conf"), F.when(sure, low).otherwise(F.array().cast("array<string>")).alias("low"))
