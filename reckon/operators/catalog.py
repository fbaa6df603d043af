"""Catalogs and schemas: row counts, database against database, columns against columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.functions.cells import base_type
from reckon.operators.naming import Rule, in_scope, mapped

# States of a pair of tables, and kinds of a column's difference.
ONLY_A, ONLY_B, UNKNOWN_ROWS, EQUAL, OTHER_ROWS = "仅A有", "仅B有", "行数未知", "一致", "行数不同"
TYPE_DIFF, LENGTH_DIFF, NULLABLE_DIFF = "类型不同", "仅长度/精度不同", "可空性不同"

COLUMN_SCHEMA = "name string, type string, nullable boolean, pos int"


def columns_of(df: DataFrame) -> DataFrame:
    """name, type, nullable and pos of df's columns."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable, i) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, COLUMN_SCHEMA)


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """name, status (only_a, only_b, differs, same), kind, types and nullability of both sides'
    columns (name, type, nullable), met by name in lower case; by name."""
    left, right = (d.select(F.lower("name").alias("k"), F.struct("name", "type", "nullable").alias(s)) for d, s in ((a, "a"), (b, "b")))
    both = left.join(right, "k", "full_outer")
    kind = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), "").when(base_type(F.col("a.type")) != base_type(F.col("b.type")), TYPE_DIFF)
        .when(F.col("a.type") != F.col("b.type"), LENGTH_DIFF).when(F.col("a.nullable") != F.col("b.nullable"), NULLABLE_DIFF).otherwise("")
    )
    status = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(kind != "", "differs").otherwise("same")
    out = both.select(F.coalesce("a.name", "b.name").alias("name"), status.alias("status"), kind.alias("kind"), F.col("a.type").alias("type_a"), F.col("b.type").alias("type_b"), F.col("a.nullable").alias("nullable_a"), F.col("b.nullable").alias("nullable_b"))
    return out.orderBy(F.lower("name"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name and rows of each table, counted in one job."""
    each = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.union, each)


def catalog(spark: SparkSession, database: str) -> DataFrame:
    """name, rows (null: a view, or it couldn't be counted) and type of a database's tables."""
    listed = [t for t in spark.catalog.listTables(database) if not t.isTemporary]
    meta = spark.createDataFrame([(t.name, t.tableType) for t in listed], "name string, type string")
    real = {t.name: spark.table(f"`{database}`.`{t.name}`") for t in listed if t.tableType not in ("VIEW", "TEMPORARY")}
    counts = row_counts(real) if real else spark.createDataFrame([], "name string, rows long")
    return meta.join(counts, "name", "left").select("name", "rows", "type")


def rollup(tables: DataFrame) -> DataFrame:
    """objects, views, empty, unknown and total_rows of a catalog (name, rows, type), in one row."""
    view = F.col("type").contains("VIEW")
    return tables.agg(F.count("*").alias("objects"), F.count_if(view).alias("views"), F.count_if(F.col("rows") == 0).alias("empty"), F.count_if(F.col("rows").isNull()).alias("unknown"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"))


def catalog_diff(a: DataFrame, b: DataFrame, rule: Rule | None = None) -> DataFrame:
    """a, b, rows_a, rows_b, delta and status of two catalogs (name, rows): names of a mapped by the
    rule and met with those of b that are in its scope, exactly by case; several of a may meet one."""
    rule = rule or Rule()
    left = a.select(F.col("name").alias("a"), mapped(F.col("name"), rule).alias("m"), F.col("rows").alias("rows_a"))
    right = b.where(in_scope(F.col("name"), rule)).select(F.col("name").alias("b"), F.col("rows").alias("rows_b"))
    both = left.join(right, F.col("m") == F.col("b"), "full_outer")
    status = (
        F.when(F.col("b").isNull(), ONLY_A).when(F.col("a").isNull(), ONLY_B).when(F.col("rows_a").isNull() | F.col("rows_b").isNull(), UNKNOWN_ROWS)
        .when(F.col("rows_a") == F.col("rows_b"), EQUAL).otherwise(OTHER_ROWS)
    )
    return both.select("a", F.coalesce("b", "m").alias("b"), "rows_a", "rows_b", (F.col("rows_b") - F.col("rows_a")).alias("delta"), status.alias("status"))


def schema_text(columns: DataFrame, most_tables: int = 80) -> DataFrame:
    """One row: text, `table t (c type PRIMARY KEY, ...)` a line for each of the first tables by name,
    from columns (table, name, type, pos, is_key), with a last line for those that are left out; and
    tables, how many there are."""
    item = F.concat_ws(" ", "name", "type", F.when(F.col("is_key"), "PRIMARY KEY"))
    per = columns.groupBy("table").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("t")))), lambda x: x["t"]), ", ").alias("cols"))
    total = columns.agg(F.countDistinct("table").alias("tables"))
    per = per.orderBy("table").limit(most_tables)
    line = F.concat(F.lit("table "), F.col("table"), F.lit(" ("), F.col("cols"), F.lit(")"))
    one = per.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text")).join(total, how="cross")  # one row by one row
    left = F.col("tables") - most_tables
    return one.select(F.when(left > 0, F.concat("text", F.lit("\n... and "), left.cast("string"), F.lit(" more tables"))).otherwise(F.col("text")).alias("text"), "tables")


def ordered_sample(df: DataFrame, columns: list[str], keys: list[str], limit: int, where: str | None = None) -> DataFrame:
    """The first rows by keys, so that two sides' samples are of the same keys."""
    own = df.where(where) if where else df
    return own.select(*columns).orderBy(*[F.col(k).asc_nulls_first() for k in keys]).limit(limit)
