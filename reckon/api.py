"""The workbench as functions: what a user asks for in one call.

Each returns DataFrames (and plain values beside them); nothing is cut but previews, whose totals
come with them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.functions.cells import FileDialect, SqlDialect
from reckon.functions.names import quoted
from reckon.operators import catalog, key_guess, keyed_diff, naming, sampling, verdicts, verified
from reckon.operators.keyed_diff import KeyedDiff, common_columns
from reckon.plans import catalyst, empties, guard, logic, rewrite, structure
from reckon.sources.delimited import read_table


@dataclass
class Comparison:
    """A difference with its verdict, which is told by counts; stats are made when they are used; scope:
    the keys whose every difference is known."""

    diff: KeyedDiff
    verdict: DataFrame
    scope: DataFrame
    notes: dict

    @cached_property
    def stats(self) -> DataFrame:
        return self.diff.stats().withColumn("ambiguous_cols", F.lit(len(self.notes.get("ambiguous", []))).cast("long"))


def open_pair(spark: SparkSession, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two files as tables, and the columns that may be their key."""
    a, b = (read_table(spark, p).drop("_row") for p in (path_a, path_b))
    return a, b, key_guess.guess_keys(a, b)


def file_diff(a: DataFrame, b: DataFrame, keys: list[str], **options: bool) -> Comparison:
    """Two tables compared by the file dialect (options: case_sensitive, trim_whitespace,
    null_equals_empty, strict_numeric)."""
    diff = KeyedDiff(a, b, keys, FileDialect(**options))
    return Comparison(diff, verdicts.file_verdict(diff.signs(flips=False)), keyed_diff.keys_in_scope(diff), {})


def resolve_column(name: str, columns: list[str]) -> str | None:
    """The column meant by a name: as it is, whatever its case, or by its part after the last dot."""
    bare = lambda x: x.replace("`", "").split(".")[-1]
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower(), lambda c: c == bare(name), lambda c: c.lower() == bare(name).lower(), lambda c: bare(c).lower() == bare(name).lower()):
        found = [c for c in columns if same(c)]
        if found:
            return found[0] if len(found) == 1 else None
    return None


def _ready(df: DataFrame, keys: list[str], sql: str, spark: SparkSession) -> tuple[DataFrame, list[str], list[str]]:
    """df with its columns by bare lower-case names, the keys among them, and those names that
    several columns have (which take no part)."""
    bare = [c.replace("`", "").split(".")[-1].lower() for c in df.columns]
    twice = sorted({c for c in bare if bare.count(c) > 1})
    resolved = []
    for k in keys:
        own = resolve_column(k, df.columns)
        if own is None and sql:
            chains = {a: structure.alias_lineage(spark, sql, a) for _, a in structure.structure(spark, sql).output}
            own = next((a for a, chain in chains.items() if k.lower() in {x.lower() for x in chain} | {x.split(".")[-1].lower() for x in chain}), None)
        if own is None:
            raise keyed_diff.DiffError(f"no column for key {k} in {', '.join(df.columns)}")
        resolved.append(own.split(".")[-1].lower())
    if set(resolved) & set(twice):
        raise keyed_diff.DiffError(f"a key's name is that of several columns: {', '.join(set(resolved) & set(twice))}")
    named = df.toDF(*[f"c{i}" for i in range(len(bare))])
    return named.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(bare) if c not in twice]), resolved, twice


def result_diff(a: DataFrame, b: DataFrame, keys: list[str], sql_a: str = "", sql_b: str = "") -> Comparison:
    """Two results compared by the SQL dialect: columns met by bare name, keys found through aliases."""
    spark = a.sparkSession
    a, keys_a, twice_a = _ready(a, keys, sql_a, spark)
    b, keys_b, twice_b = _ready(b, keys, sql_b, spark)
    b = b.withColumnsRenamed({y: x for x, y in zip(keys_a, keys_b) if x != y})
    twice = sorted(set(twice_a) | set(twice_b))
    a, b = a.drop(*[c for c in twice if c in a.columns]), b.drop(*[c for c in twice if c in b.columns])
    diff = KeyedDiff(a, b, keys_a, SqlDialect())
    signs = diff.signs().withColumn("ambiguous_cols", F.lit(len(twice)).cast("long"))
    return Comparison(diff, verdicts.sql_verdict(signs), keyed_diff.keys_in_scope(diff), {"ambiguous": twice, "keys": {"a": keys_a, "b": keys_b}})


def query_diff(spark: SparkSession, sql_a: str, sql_b: str, keys: list[str], time_column: str | None = None, start: str = "", end: str = "", batch: int = 1_000_000) -> Comparison:
    """Two queries' results over a time range, fetched by slices; verdict and scope are lowered if not
    all rows came that the slices were planned for."""
    sides: list[verified.Source] = []
    for sql in (sql_a, sql_b):
        if guard.level(sql, spark) == "blocked":
            raise guard.NotReadOnly(str(guard.findings(sql, spark)))
        df = rewrite.filter_where_seen(spark, sql, time_column, start, end)[0] if time_column else spark.sql(catalyst.dialect(sql))
        sides.append(verified.Frame(df))
    bare = resolve_column(time_column, sides[0].df.columns) if time_column else None
    if bare is None or bare not in sides[1].df.columns:
        return result_diff(sides[0].df, sides[1].df, keys, sql_a, sql_b)
    return source_diff(*sides, keys, bare, batch, sql_a, sql_b)


def source_diff(a: verified.Source, b: verified.Source, keys: list[str], time_column: str, batch: int = 1_000_000, sql_a: str = "", sql_b: str = "") -> Comparison:
    """Two sources (tables of databases, DataFrames) fetched by slices and compared; the notes have
    both accounts. Rows that were planned and didn't come lower the verdict and empty the scope."""
    got = [verified.fetch(side, time_column, batch) for side in (a, b)]
    found = result_diff(got[0].rows, got[1].rows, keys, sql_a, sql_b)
    issues = sum(len(g.issues) for g in got)
    found.notes["fetched"] = {"a": got[0], "b": got[1]}
    counts = [g.account.first()["fetched"] for g in got]
    if bool(counts[0]) != bool(counts[1]) and (sql := sql_b if counts[0] else sql_a):
        found.notes["emptied"] = empties.steps(got[0].rows.sparkSession, sql)
    found.verdict = verdicts.incomplete(found.verdict, issues)
    if issues:
        found.scope = found.scope.limit(0)
    return found


def table_diff(a: DataFrame, b: DataFrame, keys: list[str] | None = None, limit: int = 500, where_a: str | None = None, where_b: str | None = None) -> dict:
    """Schemas, counts and, given keys, the difference of a sample: all rows of the same `limit` keys of
    both sides (of all keys, if there are no more), with the share of differing keys and its bounds."""
    out: dict = {"schema": catalog.schema_diff(catalog.columns_of(a), catalog.columns_of(b))}
    own = [df.where(w) if w else df for df, w in ((a, where_a), (b, where_b))]
    out["rows"] = tuple(df.count() for df in own)
    if keys:
        common = common_columns(*own)
        drawn = sampling.draw(*[df.select(*map(quoted, common)) for df in own], keys, limit, SqlDialect())
        found = result_diff(drawn.a, drawn.b, keys)
        if not drawn.whole:
            found.verdict = verdicts.sampled(found.verdict)
            found.scope = found.scope.limit(0)
        out["sample"], out["sampled"], out["share"] = found, not drawn.whole, sampling.share(found.diff)
    return out


def sql_prepare(spark: SparkSession, sql: str, today: str) -> dict:
    """What helps to look into a query: time columns, key candidates, time range, layers, risks of
    the text."""
    return {
        "time_columns": structure.time_columns(spark, sql), "keys": structure.key_candidates(spark, sql), "range": rewrite.date_range(sql, today),
        "layers": logic.layers(spark, sql), "guard": guard.findings(sql, spark), "structure": structure.structure(spark, sql),
    }


def sql_logic_diff(spark: SparkSession, sql_a: str, sql_b: str) -> tuple[DataFrame, DataFrame, bool]:
    """Risks, the diff by clauses, and whether the two are one query."""
    return logic.risks(spark, sql_a, sql_b), logic.text_diff(spark, sql_a, sql_b), logic.identical(spark, sql_a, sql_b)


def catalog_compare(spark: SparkSession, db_a: str, db_b: str, rule: naming.Rule | None = None) -> DataFrame:
    """Two databases of the session's catalog, table by table."""
    if db_a == db_b and (rule is None or rule.mode == "same"):
        raise ValueError("a database compared with itself by the same names")
    return catalog.catalog_diff(catalog.catalog(spark, db_a), catalog.catalog(spark, db_b), rule)


def detail(spark: SparkSession, sql: str, keys: list[str], time_column: str, start: str, end: str, limit: int = 500) -> DataFrame:
    """The first rows by key of a query's result within a time range."""
    df = spark.sql(catalyst.dialect(sql)).where(rewrite.range_condition(time_column, start, end))
    return df.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).limit(limit)
