"""Why a query has no rows: its filters and joins, each on the rows that reach it, from the inside out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.plans import catalyst as C

SCHEMA = "place int, kind string, condition string, rows_in long, alone long, kept long, without long, cause boolean"


def steps(spark: SparkSession, sql: str) -> DataFrame:
    """place, kind (filter or join), condition, rows_in, alone, kept, without and cause of each condition
    of a query, WITH parts and derived tables included, in the order in which rows meet them. rows_in:
    the rows that reach its WHERE or HAVING; alone: those that it passes; kept: those that it and the
    conditions before it pass; without: those that all others of its WHERE pass. Each WHERE is one
    aggregation over its FROM; of a join, the rows of both sides are counted (alone: the right side's)
    and those of the result. The cause is the first step that rows reach and none leaves."""
    rows: list[tuple] = []

    def put(kind: str, texts: list[str], n: int, alone: list[int], kept: list[int], without: list[int]) -> None:
        for text, *counts in zip(texts, alone, kept, without):
            rows.append((len(rows), kind, text.replace("`", ""), n, *counts))

    def frame(plan, scope: list) -> DataFrame:
        for node, parts in reversed(scope):
            plan = C.with_parts(spark, node, parts, plan)
        return C.frame(spark, plan)

    def conditions(plan, own: list, scope: list) -> None:
        df, texts = frame(plan, scope), [C.sql_of(e) for e in own]
        if any(True for e in own for _ in C.expression_plans_of(e)):  # subqueries: a filter each
            on = lambda some: (frame(C.filter_by(spark, plan, C.both(spark, some)), scope) if some else df).count()
            put("filter", texts, on([]), [on([e]) for e in own], [on(own[: i + 1]) for i in range(len(own))], [on(own[:i] + own[i + 1 :]) for i in range(len(own))])
            return
        each = [F.coalesce(F.expr(t), F.lit(False)) for t in texts]
        all_of = lambda some: reduce(lambda x, y: x & y, some, F.lit(True))
        sums = [F.count("*")]
        for i, c in enumerate(each):
            sums += [F.count_if(c), F.count_if(all_of(each[: i + 1])), F.count_if(all_of(each[:i] + each[i + 1 :]))]
        got = list(df.agg(*[s.alias(f"n{i}") for i, s in enumerate(sums)]).first())
        put("filter", texts, got[0], got[1::3], got[2::3], got[3::3])

    def go(node, scope: list) -> None:
        kind = C.name(node)
        if kind == "UnresolvedWith":
            parts: list = []
            for pair in C.seq(node.cteRelations()):
                go(C.children(pair._2())[0], [*scope, (node, parts)])
                parts = [*parts, pair]
            go(C.children(node)[0], [*scope, (node, parts)])
            return
        for c in C.children(node):
            go(c, scope)
        if kind == "Filter":
            conditions(C.children(node)[0], C.conjuncts(node.condition()), scope)
        elif kind == "UnresolvedHaving":
            n, kept = frame(C.children(node)[0], scope).count(), frame(node, scope).count()
            put("filter", [C.sql_of(node.havingCondition())], n, [kept], [kept], [n])
        elif kind == "Join":
            left, right, kept = (frame(x, scope).count() for x in (*C.children(node), node))
            text = C.sql_of(node.condition().get()) if node.condition().isDefined() else node.joinType().sql()
            put("join", [text], left, [right], [kept], [left])

    go(C.parse(spark, sql), [])
    first = next((i for i, r in enumerate(rows) if r[3] > 0 and r[5] == 0), None)
    return spark.createDataFrame([(*r, i == first) for i, r in enumerate(rows)], SCHEMA)
