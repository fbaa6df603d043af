"""Help with SQL: what errors mean, what a column's grain is, probes as text, answers of a model."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reckon.plans import catalyst as C
from reckon.plans import guard
from reckon.plans.structure import alias_lineage, structure

_RULES = (
    ("UNRESOLVED_COLUMN", "The name isn't visible at this level: a subquery must put the column into its SELECT list before an outer block can use it."),
    ("TABLE_OR_VIEW_NOT_FOUND", "Check the database before the table's name, and whether this is the right cluster."),
    ("SCHEMA_NOT_FOUND", "Check the database's name, and whether this is the right cluster."),
    ("PARSE_SYNTAX_ERROR", "Spark's parser doesn't take this text; check the words around the place that it names."),
    ("MISSING_AGGREGATION|MISSING_GROUP_BY", "Columns beside an aggregate must stand in GROUP BY."),
    ("AMBIGUOUS_REFERENCE", "Several sides have this column: put the alias of one before it."),
    ("CAST_INVALID_INPUT", "A value doesn't fit the type: try_cast gives NULL instead, and shows which."),
    ("OutOfMemory|exceed.*memory|Memory limit", "Narrow the time range or add filters first."),
    (r"Column '[^']+' cannot be resolved|Unknown column", "The name isn't visible at this level, or is misspelt."),
    (r"Unknown table|doesn't exist|Unknown database", "Check the database before the table's name, and whether this is the right cluster."),
)


def explain_error(message: str) -> str:
    """The message with advice after it, if a rule fits."""
    for pattern, advice in _RULES:
        if re.search(pattern, message, re.I):
            return f"{message}\n\n{advice}"
    return message


_DAY = re.compile(r"(?i)\b(to_date|date)\s*\(|date_format\s*\([^,]+,\s*'(%Y[-/]?%m([-/]?%d)?|y+[-/]?M+([-/]?d+)?)'")


def is_day_grain(spark: SparkSession, sql: str, column: str) -> bool:
    """Whether a column of the result is made by a function that leaves only the day."""
    return any(_DAY.search(step) for step in alias_lineage(spark, sql, column))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def probe_texts(spark: SparkSession, sql: str, keys: list[str]) -> DataFrame:
    """id and sql of probes of a query: P0 rows, P1 repeated keys, P2 rows against keys, and for each
    join J rows that find no partner (a template: the left side stands in braces) and M keys of the
    right side that multiply; F1 rows that are left after each condition in turn (a template too: the
    joined tables stand in braces)."""
    text, key = C.strip_comments(sql).strip().rstrip(";"), ", ".join(keys)
    rows = [
        ("P0", f"SELECT count(*) AS n FROM ({text}) q"), ("P1", f"SELECT {key}, count(*) AS n FROM ({text}) q GROUP BY {key} HAVING count(*) > 1"),
        ("P2", f"SELECT count(*) AS n, count(DISTINCT {key}) AS n_keys FROM ({text}) q"),
    ]
    parts = structure(spark, sql)
    ladder = [f"SELECT {i} AS place, {_quoted(c)} AS condition, count_if({' AND '.join(['true', *parts.conditions[:i]])}) AS n FROM {{source}}" for i, c in enumerate(["all", *parts.conditions])]
    if parts.conditions:
        rows.append(("F1", " UNION ALL ".join(ladder)))
    for i, j in enumerate(reversed(parts.joins), 1):
        if j.on:
            rows.append((f"J{i}", f"SELECT count(*) AS n FROM {{left}} LEFT ANTI JOIN {j.table} ON {j.on}"))
            own = [a for pair in re.findall(r"([\w.]+) = ([\w.]+)", j.on) for a in pair]
            side = sorted({a.split(".")[-1] for a in own[1::2]})
            if side:
                rows.append((f"M{i}", f"SELECT {', '.join(side)}, count(*) AS n FROM {j.table} GROUP BY {', '.join(side)} HAVING count(*) > 1"))
    return spark.createDataFrame(rows, "id string, sql string")


def first_object(text: str | None) -> dict | None:
    """The first JSON object in a text."""
    decoder, text = json.JSONDecoder(), text or ""
    for m in re.finditer(r"\{", text):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except json.JSONDecodeError:
            continue
    return None


def asked(model: Callable[[str], str], prompt: str) -> dict:
    """A model's answer (any function of a prompt): its object, with `sql` blanked and the findings
    given if the audit blocks it."""
    answer = first_object(model(prompt)) or {}
    sql = str(answer.get("sql") or "")
    if sql and guard.level(sql) == "blocked":
        answer |= {"sql": "", "blocked": [r for x, r in guard.findings(sql) if x == "blocked"]}
    return answer
