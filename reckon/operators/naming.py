"""Table names across databases: mapping rules, scope, discovery by prefix, the store of pairs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ways to map names.
MODES = ("same", "source_to_target", "target_to_source", "affix", "regex", "pairs", "saved")


@dataclass
class Rule:
    mode: str = "same"
    db: str = ""  # the source database's name
    prefix_del: str = ""
    prefix_add: str = ""
    suffix_del: str = ""
    suffix_add: str = ""
    pattern: str = ""
    replace: str = ""
    pairs: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"no such mode: {self.mode}")
        if self.mode == "affix" and not (self.prefix_del or self.prefix_add or self.suffix_del or self.suffix_add):
            raise ValueError("affix needs at least one part")
        if self.mode == "regex" and not self.pattern:
            raise ValueError("regex needs a pattern")
        if self.mode in ("pairs", "saved") and not self.pairs:
            raise ValueError("no pairs of names")


def parse_pairs(text: str) -> dict[str, str]:
    """Pairs from lines `a => b`, `a -> b`, `a,b`, or `a b` (tab or blanks); others are passed by."""
    out = {}
    for line in text.splitlines():
        m = re.fullmatch(r"\s*([^\s,=>-][^\s,=>]*?)\s*(?:=>|->|,|\t|\s)\s*([^\s,=>]+)\s*", line)
        if m:
            out[m.group(1)] = m.group(2)
    return out


def java_replacement(text: str) -> str:
    r"""A Python replacement (\1, \g<name>) as Java has it, with $ taken literally."""
    text = text.replace("$", r"\$")
    return re.sub(r"\\(\d+)|\\g<(\w+)>", lambda m: f"${m.group(1)}" if m.group(1) else f"${{{m.group(2)}}}", text)


def mapped(name: Column, rule: Rule) -> Column:
    """The other side's name of a table, by a rule."""
    target = f"target_{rule.db.strip()}_"
    if rule.mode == "source_to_target":
        return F.concat(F.lit(target), name)
    if rule.mode == "target_to_source":
        return F.when(name.startswith(target), F.substr(name, F.lit(len(target) + 1))).otherwise(name)
    if rule.mode == "affix":
        if rule.prefix_del:
            name = F.when(name.startswith(rule.prefix_del), F.substr(name, F.lit(len(rule.prefix_del) + 1))).otherwise(name)
        if rule.suffix_del:
            name = F.when(name.endswith(rule.suffix_del), F.substr(name, F.lit(1), F.length(name) - len(rule.suffix_del))).otherwise(name)
        return F.concat(F.lit(rule.prefix_add), name, F.lit(rule.suffix_add))
    if rule.mode == "regex":
        return F.regexp_replace(name, rule.pattern, java_replacement(rule.replace))
    if rule.mode in ("pairs", "saved"):
        table = F.create_map(*[F.lit(x) for kv in rule.pairs.items() for x in kv])
        return F.coalesce(F.try_element_at(table, name), name)
    return name


def in_scope(name: Column, rule: Rule) -> Column:
    """Whether a table of the other side takes part in a comparison under the rule."""
    if rule.mode == "saved":
        return F.lower(name).isin(*{v.lower() for v in rule.pairs.values()})
    if rule.mode == "source_to_target" and rule.db.strip():
        return name.startswith(f"target_{rule.db.strip()}_")
    return F.lit(True)


def discover_pairs(a: DataFrame, b: DataFrame, rule: Rule) -> DataFrame:
    """a and b (null if none): tables of a by name, and what their mapped names meet in b, whatever
    their case."""
    left = a.select(F.col("name").alias("a"), F.lower(mapped(F.col("name"), rule)).alias("m"))
    right = b.select(F.col("name").alias("b"), F.lower("name").alias("m")).groupBy("m").agg(F.min("b").alias("b"))
    return left.join(right, "m", "left").select("a", "b")


def split_by_database(tables: DataFrame, databases: DataFrame, prefix: str = "target_") -> DataFrame:
    """name, db, source: names `<prefix><db>_<table>` split by the longest database that fits; db and
    source are empty for those that none fits. Each name is cut at each of its underscores and met
    with the databases by equality, so names and databases aren't all paired."""
    body = F.substr("name", F.lit(len(prefix) + 1))
    words = F.split(body, "_")
    cuts = F.when(F.col("name").startswith(prefix) & (F.size(words) > 1), F.sequence(F.lit(1), F.size(words) - 1))
    cut = tables.select("name", body.alias("body"), words.alias("w"), F.explode(cuts).alias("i"))
    cut = cut.select("name", F.array_join(F.slice("w", 1, F.col("i")), "_").alias("db"), F.substr("body", F.length(F.array_join(F.slice("w", 1, F.col("i")), "_")) + 2).alias("source"))
    met = cut.join(databases.select(F.col("name").alias("db")).distinct(), "db").groupBy("name").agg(F.max_by(F.struct("db", "source"), F.length("db")).alias("x"))
    out = tables.join(met, "name", "left")
    return out.select("name", F.coalesce("x.db", F.lit("")).alias("db"), F.coalesce("x.source", F.lit("")).alias("source"))


def unknown_prefixes(split: DataFrame, prefix: str = "target_") -> DataFrame:
    """word and n: the first word after the prefix of names that no database fits."""
    body = F.substr("name", F.lit(len(prefix) + 1))
    word = F.when(F.col("name").startswith(prefix), F.split(body, "_")[0]).otherwise("(none)")
    return split.where("db = ''").groupBy(word.alias("word")).agg(F.count("*").alias("n"))


STORE_SCHEMA = "group_key string, kind string, db string, a string, b string, saved_at string"


def save_pairs(store: DataFrame, group_key: str, pairs: DataFrame, saved_at: str, kind: str = "pairs", db: str = "") -> DataFrame:
    """The store with a group's pairs (a, b) in place of those it had; no pairs: the group is gone."""
    rest = store.where(~((F.col("group_key") == group_key) & (F.col("db") == db)))
    new = pairs.where("b is not null").select(F.lit(group_key).alias("group_key"), F.lit(kind).alias("kind"), F.lit(db).alias("db"), "a", "b", F.lit(saved_at).alias("saved_at"))
    return rest.unionByName(new)


def pairs_of(store: DataFrame, group_key: str, word: str = "", db: str = "", limit: int = 500) -> tuple[DataFrame, int]:
    """A group's pairs with the word in a, b or db, the first `limit` by name, and how many there are."""
    own = store.where(F.col("group_key") == group_key)
    if db:
        own = own.where(F.col("db") == db)
    if word:
        w = word.lower()
        own = own.where(F.lower("a").contains(w) | F.lower("b").contains(w) | F.lower("db").contains(w))
    return own.orderBy("db", "a").limit(limit), own.count()


def saved_for(store: DataFrame, group_key: str, whole_key: str, db: str) -> DataFrame:
    """a, b: pairs saved for exactly this group, and else those of the database in the whole
    catalog's map."""
    exact = store.where(F.col("group_key") == group_key).select("a", "b")
    whole = store.where((F.col("group_key") == whole_key) & (F.col("db") == db)).select("a", "b")
    return whole if exact.isEmpty() else exact
