"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from reckon.ship import ship
from reckon.store import keep, scratch


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder that driver and executors share (spark.checkpoint.dir)."""
    return scratch(spark, purpose)


def through_store(df: DataFrame, purpose: str) -> DataFrame:
    """df written once as Parquet into the shared folder and read back: cuts the lineage, and
    survives the loss of any executor."""
    return keep(df, purpose)


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def blocks(texts: list[str | None], most_chars: int = 500_000) -> Iterator[tuple[int, int]]:
    """Consecutive slices [a, b) of texts of about most_chars characters, at least one text each."""
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and size + n > most_chars:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of a partition's batches; empty ones are passed over. f's columns
    come in the schema's order. Names may be anything: columns travel under plain ones."""
    ship(df.sparkSession)
    out = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names, plain = df.columns, [f"c{i}" for i in range(len(df.columns))]
    coded = StructType([StructField(f"c{i}", x.dataType, x.nullable) for i, x in enumerate(out.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in f(b.rename_columns(names) for b in batches if b.num_rows):
            yield b.rename_columns(coded.names)

    return df.toDF(*plain).mapInArrow(run, coded).toDF(*out.names)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of one batch; empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = f(b)
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return map_batches(df, run, schema)


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever it has in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores before it until no column of df has it (whatever its case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def meet(rows: DataFrame, one: DataFrame, key: str, hot: str) -> DataFrame:
    """The inner join of rows with `one` (a row for each key). Keys for which the condition `hot` on
    `one` holds must be few; their rows are met by broadcast, so none of them is gathered in one task."""
    few, rest = one.where(hot), one.where(f"not ({hot})")
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key))
