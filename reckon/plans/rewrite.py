"""Rewrites of queries as plans: time filters at the place that sees the column, aggregates to
detail rows, counts and histograms. A filter is a node of its own, so it binds as AND whatever
stands in the query's own WHERE, and it goes below every branch of a union. WITH parts stay in the
plan that they are part of: nothing is registered in the session."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.plans import catalyst as C
from reckon.plans.scopes import Names, Scopes, Seen, one, relation

_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


def bounds(low: str, high: str) -> tuple[str, str]:
    """Both ends of a range, complete: a date, minute or second as lower end begins, as upper end
    lasts to its last microsecond."""
    whole = lambda s, rest: s + rest[len(s) :] if len(s) < len(rest) else s
    low, high = low.strip(), high.strip()
    return whole(low, "0000-00-00 00:00:00"), whole(high, "9999-99-99 23:59:59.999999")


def range_condition(column: str, low: str, high: str, day_text: bool = False) -> str:
    """SQL of a range over a time column, kept bare so that partitions and statistics are of use;
    a column of yyyyMMdd or date texts is compared by day."""
    a, z = bounds(low, high)
    if day_text:
        return f"coalesce(try_to_date({column}, 'yyyyMMdd'), try_to_date({column})) BETWEEN DATE '{a[:10]}' AND DATE '{z[:10]}'"
    return f"{column} BETWEEN TIMESTAMP_NTZ '{a}' AND TIMESTAMP_NTZ '{z}'"


def filter_where_seen(spark: SparkSession, sql: str, column: str, low: str, high: str) -> tuple[DataFrame, str]:
    """The query with the range put on the FROM of every innermost block that sees the column, also in
    its WITH parts, or else on its result. Ranges over the column that the query has itself give way,
    in whichever block they stand and by whatever name it has there: conditions joined by AND in WHERE,
    HAVING or ON that compare it, its date or a text of its date with constants get the new bounds.

    The mode tells what was done: replaced, pushed_down or injected; with +range_left if a range over
    the column is still there (under OR or NOT). Where several tables of a block have the column, it must
    be named with its table (scopes.Ambiguous)."""
    plan = C.parse(spark, sql)
    scopes = Scopes.of_query(spark, plan, column)
    done: set[str] = set()  # names of WITH parts that are filtered
    hits = replaced = left = 0

    def filtered_below(node) -> bool:
        return bool({relation(x).lower() for x in C.walk(node) if C.name(x) == "UnresolvedRelation"} & done)

    def within(seen: Seen):
        return C.expression(spark, range_condition(seen.text, low, high, seen.grain == "day"))

    def bounded(condition, names: Names):
        """The condition with new bounds in place of its own."""
        nonlocal replaced, left
        out, new = [], {}
        for e in C.conjuncts(condition):
            if seen := scopes.range_over(e, names):
                replaced += 1
                new[seen.text] = within(seen)
            else:
                left += scopes.ranges_within(e, names)
                out.append(e)
        return C.both(spark, out + list(new.values())) if new else condition

    def go(node) -> tuple[object, Names]:
        nonlocal hits
        kind = C.name(node)
        if kind == "UnresolvedWith":
            outer, parts = dict(scopes.parts), []
            for pair in C.seq(node.cteRelations()):
                before = hits
                own, given = go(C.children(pair._2())[0])
                scopes.parts[pair._1().lower()] = given
                if hits > before:
                    done.add(pair._1().lower())
                parts.append(C.part_like(spark, pair, own))
            child, given = go(C.children(node)[0])
            scopes.parts = outer
            return C.with_parts(spark, node, parts, child), given
        before, kids = hits, [go(c) for c in C.children(node)]
        names = [n for _, n in kids]
        node = C.with_children(spark, node, [k for k, _ in kids])
        given = scopes.above(node, names)
        if kind == "Filter":
            node = C.filter_by(spark, kids[0][0], bounded(node.condition(), names[0]))
        elif kind == "UnresolvedHaving":
            node = C.having_by(spark, kids[0][0], bounded(node.havingCondition(), names[0]))
        elif kind == "Join" and node.condition().isDefined():
            node = C.joined_on(spark, node, bounded(node.condition().get(), names[0] + names[1]))
        if hits > before or kind not in ("Project", "Aggregate") or filtered_below(node) or not kids:
            return node, given
        if seen := one(names[0].times(), column):
            hits += 1
            node = C.with_children(spark, node, [C.filter_by(spark, kids[0][0], within(seen))])
        return node, given

    plan, given = go(plan)
    rest = "+range_left" if left else ""
    if hits or done:
        return C.frame(spark, plan), ("replaced" if replaced else "pushed_down") + rest
    return C.frame(spark, plan).where(range_condition(column, low, high)), "injected" + rest


def count(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(C.dialect(sql)).agg(F.count("*").alias("n"))


def detail(spark: SparkSession, sql: str) -> DataFrame:
    """The rows that the outermost aggregation takes in: its FROM and WHERE, without DISTINCT, GROUP
    BY, HAVING, ORDER BY and LIMIT; WITH parts stay around them."""

    def inner(node):
        if C.name(node) == "UnresolvedWith":
            return C.with_children(spark, node, [inner(C.children(node)[0])])
        while C.name(node) in ("Sort", "GlobalLimit", "LocalLimit", "UnresolvedHaving", "Distinct", "Offset"):
            node = C.children(node)[0]
        return C.children(node)[0] if C.name(node) in ("Aggregate", "Project") else node

    return C.frame(spark, inner(C.parse(spark, sql)))


def detail_select(spark: SparkSession, sql: str, keys: list[str], time_column: str | None = None) -> DataFrame:
    """Keys, time and the columns that are aggregated, row by row."""
    from reckon.plans.structure import outer_block

    df = detail(spark, sql)
    block = outer_block(C.parse(spark, sql))
    measures: list[str] = []

    def inner(e, within: bool) -> None:
        if C.name(e) == "UnresolvedFunction" and re.match(r"(?i)sum|count|avg|max|min", C.sql_of(e)):
            within = True
        if C.name(e) == "UnresolvedAttribute" and within:
            measures.append(".".join(C.seq(e.nameParts())))
        for c in C.children(e):
            inner(c, within)

    for e in C.seq(block.aggregateExpressions()) if C.name(block) == "Aggregate" else []:
        inner(e, False)
    wanted = list(dict.fromkeys([*keys, *([time_column] if time_column else []), *measures]))
    return df.select(*[F.col(c).alias(c.split(".")[-1]) for c in wanted])


def date_range(sql: str, today: str) -> tuple[str, str]:
    """The least and greatest date literal of a text (from 2000 to five years from today; dates that
    stand for no end don't count), or the month to date."""
    # Dates that stand for "no limit".
    no_end = {"1900-01-01", "1970-01-01", "2099-12-31", "9999-12-31", "2999-12-31", "3000-01-01"}
    found = [d for d in re.findall(r"'(\d{4}-\d{2}-\d{2})", sql) if d not in no_end and 2000 <= int(d[:4]) <= int(today[:4]) + 5]
    return (min(found), max(found)) if found else (today[:8] + "01", today)


def histogram(df: DataFrame, column: str | Column, grain: str) -> DataFrame:
    """segment (start) and n of each day, hour or minute that has rows."""
    c = F.col(column) if isinstance(column, str) else column
    return df.where(c.isNotNull()).groupBy(F.date_trunc(grain, c).cast("timestamp_ntz").alias("segment")).agg(F.count("*").alias("n"))
