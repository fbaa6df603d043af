"""SQL text as Catalyst plans: parsing, walking, rebuilding and running them."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CJK = re.compile(r"(?<![`\w])([\w一-鿿]*[一-鿿][\w一-鿿]*)(?![`\w])")
_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`")


class ParseError(ValueError):
    """SQL that Spark's parser doesn't take."""


def outside_quotes(sql: str, f) -> str:
    """sql with f applied to its parts outside quotes and backticks."""
    out, at = [], 0
    for m in _QUOTED.finditer(sql):
        out += [f(sql[at : m.start()]), m.group()]
        at = m.end()
    return "".join([*out, f(sql[at:])])


def strip_comments(sql: str) -> str:
    """sql without /* */ and without -- comments; like MySQL, -- needs a blank, a control character
    or the end of the text after it."""
    out, at = [], 0
    token = re.compile(_QUOTED.pattern + r"|/\*.*?(?:\*/|$)|--(?=[\x00-\x20\x7f]|$)[^\r\n]*", re.S)
    for m in token.finditer(sql):
        out.append(sql[at : m.start()])
        out.append(" " if m.group()[:2] in ("/*", "--") else m.group())
        at = m.end()
    return "".join([*out, sql[at:]])


def dialect(sql: str) -> str:
    """sql as Spark's parser takes it: names with Chinese characters quoted, @variables as names,
    types of other databases by Spark's names."""
    sql = strip_comments(sql).strip().rstrip(";").strip()
    sql = outside_quotes(sql, lambda s: _CJK.sub(r"`\1`", s))
    sql = outside_quotes(sql, lambda s: re.sub(r"@(\w+)", r"var_\1", s))
    sql = outside_quotes(sql, lambda s: re.sub(r"(?i)\blargeint\b", "decimal(38,0)", s))
    return outside_quotes(sql, lambda s: re.sub(r"(?i)\bdatetime(?=\s*[,)])", "timestamp_ntz", s))


def parse(spark: SparkSession, sql: str):
    """The unresolved logical plan (a JVM object) of sql."""
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(dialect(sql))
    except Exception as e:  # py4j wraps the parser's exception
        raise ParseError(str(e).split("\n")[0]) from e


def name(node) -> str:
    return node.getClass().getSimpleName()


def seq(scala) -> list:
    return [scala.apply(i) for i in range(scala.size())]


def children(node) -> list:
    return seq(node.children())


def ctes(node) -> list[tuple[str, object]]:
    """(name, plan) of a WITH node."""
    return [(pair._1(), pair._2()) for pair in seq(node.cteRelations())]


def expression_plans(node) -> Iterator[object]:
    """Plans of subqueries in a node's expressions."""

    for e in seq(node.expressions()):
        yield from expression_plans_of(e)


def expression_plans_of(e) -> Iterator[object]:
    """Plans of subqueries in an expression."""
    if name(e) == "InSubquery":
        yield from expression_plans_of(e.query())
    elif name(e) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        yield e.plan()
    else:
        for c in children(e):
            yield from expression_plans_of(c)


def walk(node) -> Iterator[object]:
    """All nodes, from the root down, of the plan, its WITH parts and its subqueries."""
    yield node
    if name(node) == "UnresolvedWith":
        for _, plan in ctes(node):
            yield from walk(plan)
    for plan in expression_plans(node):
        yield from walk(plan)
    for c in children(node):
        yield from walk(c)


def sql_of(expression) -> str:
    return expression.sql()


def conjuncts(e) -> list:
    if name(e) == "And":
        return conjuncts(e.left()) + conjuncts(e.right())
    return [e]


def frame(spark: SparkSession, plan) -> DataFrame:
    """The DataFrame of a logical plan."""
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def with_children(spark: SparkSession, node, new: list):
    return node.withNewChildren(spark._jvm.PythonUtils.toSeq(new)) if new else node


def filtered(spark: SparkSession, plan, condition: str):
    """plan below a Filter of the condition: joined by AND with all that is below, whatever its form."""
    e = spark._jsparkSession.sessionState().sqlParser().parseExpression(condition)
    return getattr(spark._jvm.org.apache.spark.sql.catalyst.plans.logical, "Filter")(e, plan)


def expression(spark: SparkSession, text: str):
    """The JVM expression of a text."""
    return spark._jsparkSession.sessionState().sqlParser().parseExpression(text)


def having_by(spark: SparkSession, plan, condition):
    """plan below a HAVING of a JVM expression."""
    return getattr(spark._jvm.org.apache.spark.sql.catalyst.analysis, "UnresolvedHaving")(condition, plan)


def joined_on(spark: SparkSession, node, condition):
    """A Join node like `node`, with this JVM expression as its ON."""
    return node.copy(node.left(), node.right(), node.joinType(), spark._jvm.scala.Option.apply(condition), node.hint())


def filter_by(spark: SparkSession, plan, expression):
    """plan below a Filter of a JVM expression."""
    return getattr(spark._jvm.org.apache.spark.sql.catalyst.plans.logical, "Filter")(expression, plan)


def both(spark: SparkSession, expressions: list):
    """The conjunction of JVM expressions."""
    out = expressions[0]
    for e in expressions[1:]:
        out = getattr(spark._jvm.org.apache.spark.sql.catalyst.expressions, "And")(out, e)
    return out


def with_parts(spark: SparkSession, node, parts: list, child):
    """A WITH node like `node`, with these parts (as its cteRelations has them) around child."""
    return node.copy(child, spark._jvm.PythonUtils.toSeq(parts), node.allowRecursion())


def part_like(spark: SparkSession, pair, plan):
    """A WITH part like `pair`, of another plan."""
    alias = pair._2()
    return pair.copy(pair._1(), with_children(spark, alias, [plan]), pair._3()) if hasattr(pair, "_3") else pair.copy(pair._1(), with_children(spark, alias, [plan]))


def attributes(e) -> list[list[str]]:
    """Name parts of all columns in an expression (not in its subqueries)."""
    own = [list(seq(e.nameParts()))] if name(e) == "UnresolvedAttribute" else []
    return own + [a for c in children(e) for a in attributes(c)]
