"""Read-only audit of SQL. What Spark's parser can read is judged by its plan: a query has no command
and no insertion in it. Statements of other dialects are judged by their words. Some rules look at
words in any case, for what a plan doesn't show: executable comments, templates, several statements,
and words that write (as bare words, so a column of such a name is refused too)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession

from reckon.plans import catalyst as C

# Words a read-only statement begins with, and words it mustn't have.
READ_HEADS = ("select", "show", "desc", "describe", "explain", "with")
WRITE_WORDS = (
    "insert", "update", "delete", "merge", "replace", "drop", "alter", "create", "truncate", "grant", "revoke",
    "call", "execute", "set", "use", "load", "unload", "copy", "outfile", "into",
)
LARGE_LIMIT = 10_000

_TOKEN = re.compile(
    r"""(?P<special>/\*[mM]?!.*?(?:\*/|$))
      | (?P<comment>/\*.*?(?:\*/|$) | --(?=[\x00-\x20\x7f]|$)[^\r\n]*)
      | (?P<text>'(?:[^'\\]|\\.|'')*(?:'|$) | "(?:[^"\\]|\\.|"")*(?:"|$))
      | (?P<word>[A-Za-z_]\w*) | (?P<number>\d+) | (?P<sign>\S)""",
    re.S | re.X,
)
_TEMPLATE = re.compile(r"\$\{[^}]+\}|\{\{[^}]+\}\}")
_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
#: Commands that only tell something begin so.
_TELLING = ("Show", "Describe", "Explain")


@dataclass(frozen=True)
class Script:
    """A text as tokens (kind, lower-cased text) without comments, and Spark's view of it."""

    raw: str
    spark: SparkSession | None = None

    @cached_property
    def all(self) -> list[tuple[str, str]]:
        return [(m.lastgroup, m.group().lower()) for m in _TOKEN.finditer(self.raw)]

    @cached_property
    def tokens(self) -> list[tuple[str, str]]:
        return [t for t in self.all if t[0] not in ("special", "comment")]

    @cached_property
    def statements(self) -> int:
        ends = [i for i, t in enumerate(self.tokens) if t == ("sign", ";")]
        return 1 + len(ends) - (bool(ends) and ends[-1] == len(self.tokens) - 1)

    @cached_property
    def head(self) -> str:
        return self.tokens[0][1] if self.tokens and self.tokens[0][0] == "word" else ""

    def after(self, word: str, kind: str) -> list[str]:
        """Tokens of a kind that directly follow a word."""
        return [b[1] for a, b in zip(self.tokens, self.tokens[1:]) if a == ("word", word) and b[0] == kind]

    @cached_property
    def reads(self) -> bool:
        """By the plan if there is one, else by the first word."""
        if self.spark and self.statements == 1:
            try:
                return plan_reads(self.spark, C.parse(self.spark, self.raw))
            except C.ParseError:
                pass
        return self.head in READ_HEADS

    @property
    def is_query(self) -> bool:
        return self.head in ("select", "with")


def plan_reads(spark: SparkSession, plan) -> bool:
    """Whether no part of a plan changes anything."""
    gateway = spark.sparkContext._gateway

    def changes(node) -> bool:
        kinds = ("Command", "ParsedStatement", "InsertIntoStatement")
        return not C.name(node).startswith(_TELLING) and any(is_instance_of(gateway, node, _LOGICAL + k) for k in kinds)

    return not any(map(changes, C.walk(plan)))


#: (level, code, when), in the order in which they are told.
RULES: tuple[tuple[str, str, Callable[[Script], bool]], ...] = (
    ("blocked", "executable_comment", lambda s: any(kind == "special" for kind, _ in s.all)),
    ("blocked", "several_statements", lambda s: s.statements > 1),
    ("blocked", "not_a_query", lambda s: not s.reads),
    ("blocked", "write_words", lambda s: any(kind == "word" and text in WRITE_WORDS for kind, text in s.tokens)),
    ("blocked", "template", lambda s: bool(_TEMPLATE.search(s.raw))),
    ("warning", "select_all", lambda s: s.is_query and "*" in s.after("select", "sign")),
    ("warning", "no_limit", lambda s: s.is_query and not s.after("limit", "number")),
    ("warning", "large_limit", lambda s: any(int(n) > LARGE_LIMIT for n in s.after("limit", "number")[:1])),
)


def findings(sql: str | None, spark: SparkSession | None = None) -> list[tuple[str, str]]:
    """(level, rule): blocked or warning; quoted text and plain comments don't count."""
    script = Script((sql or "").strip(), spark)
    if not script.raw:
        return [("blocked", "empty")]
    return [(level, code) for level, code, when in RULES if when(script)]


def level(sql: str | None, spark: SparkSession | None = None) -> str:
    levels = {x for x, _ in findings(sql, spark)}
    return next((x for x in ("blocked", "warning") if x in levels), "safe")


def audit(spark: SparkSession, statements: list[tuple[int, str]]) -> DataFrame:
    """id, level and rules of each (id, sql)."""
    rows = [(i, level(s, spark), ",".join(r for _, r in findings(s, spark))) for i, s in statements]
    return spark.createDataFrame(rows, "id int, level string, rules string")


class NotReadOnly(ValueError):
    """A statement that the audit blocks."""


def query(spark: SparkSession, sql: str, limit: int | None = None) -> tuple[DataFrame, bool]:
    """The rows of a read-only query, and whether there are more than `limit` of them (exactly: one
    row more is asked for)."""
    if blocked := [r for x, r in findings(sql, spark) if x == "blocked"]:
        raise NotReadOnly(", ".join(blocked))
    df = spark.sql(C.dialect(sql))
    if limit is None:
        return df, False
    return df.limit(limit), df.limit(limit + 1).count() > limit
