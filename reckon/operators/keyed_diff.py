"""Keyed difference of two tables, with duplicate keys paired by content.

Rows are normalised by a dialect and counted by 128 bits of hashes of their key and as many of their
content: a hash aggregation of numbers alone, with partial counts before the shuffle, so a key or a
content with a third of all rows is a handful of rows in it, and nothing is sorted. Texts are fetched
afterwards, by the hashes, only for what differs. Two sides with equal sums of hashes are equal, and are
counted by one side alone. Verdicts are told by counts, and pair rows only where blank cells may decide. Contents that both sides have pair exactly, as often
as the rarer side has them. Of what is left of a key, one row against one pairs by itself; groups of
up to two rows a side take the cheaper way (in the JVM), other small groups pair by least total number
of differing columns (a Hungarian assignment, on executors). In groups of more than `exact_limit` rows
on a side, rows that are alike but for one column pair first, then those but for two, and the rest in
order of content; such groups are reported as approximate. Rows beyond the other side's count are
unmatched.

Since rows are taken by counts, results don't depend on the order of the input, and need no row
numbers. The raw value shown for a content is the least raw row that has it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import combinations
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reckon.functions.cells import Dialect, FileDialect, key_text, kind_of
from reckon.functions.names import quoted
from reckon.operators import ranks, sieve
from reckon.operators.assignment import assign, pair_costs
from reckon.ship import ship
from reckon.store import keep

EXACT_LIMIT = 200
#: Keys with more rows left (at most rows / HOT of them) are met by broadcast.
HOT = 1_000_000
#: Hashes of a key and of a content.
KEY, CONTENT = ("hk1", "hk2"), ("hv1", "hv2")
#: Rounds of proposals without one column and without two, and how many such sets there may be.
ROUNDS, MOST_LOST = {1: 2, 2: 1}, 60
#: Cells without a value, by either dialect.
BLANK = ("", "null|", "empty|")
#: What counts are taken beside: pairs of rows left over, keys of which such rows have blank cells.
_SIGNS = ("_pairs", "_blanks")
_PAIR = ("k", "raw_key", "v_a", "raw_a", "v_b", "raw_b", "n")


class DiffError(ValueError):
    """Inputs that can't be compared."""


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of both, by exact name, in a's order."""
    return [c for c in a.columns if c in set(b.columns)]


def _check(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    for side, df in (("A", a), ("B", b)):
        low = [c.strip().lower() for c in df.columns]
        if twice := sorted({c for c in low if low.count(c) > 1}):
            raise DiffError(f"side {side} has repeated column names: {', '.join(twice)}")
        if missing := [k for k in keys if k not in df.columns]:
            raise DiffError(f"side {side} has no key column {', '.join(missing)}")
    if not keys:
        raise DiffError("no key columns are given")


@dataclass
class KeyedDiff:
    """a and b compared by keys; each result is a DataFrame that is computed when it is used."""

    a: DataFrame
    b: DataFrame
    keys: list[str]
    dialect: Dialect = FileDialect()
    compare: list[str] | None = None
    exact_limit: int = EXACT_LIMIT

    def __post_init__(self) -> None:
        _check(self.a, self.b, self.keys)
        if self.compare is None:
            self.compare = [c for c in common_columns(self.a, self.b) if c not in self.keys]

    def _side(self, side: str) -> DataFrame:
        """One side's rows: hashes of key and content, side, k and v (normalised key and content),
        raw_k and raw (as they came)."""
        df = self.a if side == "a" else self.b
        kind = {f.name: kind_of(f.dataType) for f in df.schema.fields}
        norm = lambda cs: F.array(*[self.dialect(quoted(c), kind[c]) for c in cs]).cast("array<string>")
        raw = lambda cs: F.array(*[quoted(c).cast("string") for c in cs]).cast("array<string>")
        own = df.select(F.lit(side).alias("side"), norm(self.keys).alias("k"), norm(self.compare).alias("v"), raw(self.keys).alias("raw_k"), raw(self.compare).alias("raw"))
        return own.select(*[F.xxhash64(F.lit(i), c).alias(f"h{c}{i}") for c in "kv" for i in (1, 2)], "*")

    @cached_property
    def _equal(self) -> bool:
        """Whether both sides have the same rows, as often: as many, and with the same sums of four 30-bit
        parts of hashes. Scans that shuffle nothing; hashes are made only where counts are equal."""
        if self.a.count() != self.b.count():
            return False
        parts = [F.shiftright(F.shiftleft(F.xxhash64(F.lit(i), *KEY, *CONTENT), cut), 34) for i in (1, 2) for cut in (0, 30)]
        own = [tuple(self._side(s).select(*KEY, *CONTENT).agg(F.count("*"), *map(F.sum, parts)).first()) for s in "ab"]
        return own[0] == own[1]

    def _tallied(self) -> DataFrame:
        """tally, not kept."""
        blank = reduce(or_, [F.col("v")[i].isin(*BLANK) for i in range(len(self.compare))], F.lit(False)).alias("blank")
        if self._equal:
            n = F.count("*")
            return self._side("a").select(*KEY, *CONTENT, blank).groupBy(*KEY, *CONTENT).agg(n.alias("na"), n.alias("nb"), F.max("blank").alias("blank"))
        both = [self._side(s).select(*KEY, *CONTENT, blank, *[F.lit(int(s == x)).cast("long").alias(f"n{x}") for x in "ab"]) for s in "ab"]
        return both[0].union(both[1]).groupBy(*KEY, *CONTENT).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.max("blank").alias("blank"))

    @cached_property
    def tally(self) -> DataFrame:
        """The hashes of each content of each key, na and nb: how many rows each side has, and blank:
        whether a cell is. One aggregation over the rows of both sides, so the sides aren't joined. Kept."""
        return keep(self._tallied(), "tally")

    @cached_property
    def groups(self) -> DataFrame:
        """Counts of each key (by its hashes): rows, exact pairs, rows left over, and whether some of
        these have blank cells."""
        return self._grouped(self.tally)

    def _once(self) -> DataFrame:
        """groups for a single use: nothing is kept for it."""
        if "tally" in self.__dict__:
            return self.groups
        if not self._equal:
            return self._grouped(self._tallied())
        n, none = F.col("na"), F.lit(0).cast("long")
        own = self._side("a").groupBy(*KEY).agg(F.count("*").alias("na"))
        return own.select(*KEY, "na", n.alias("nb"), n.alias("exact"), none.alias("left_a"), none.alias("left_b"), F.lit(False).alias("blank"))

    @staticmethod
    def _grouped(tally: DataFrame) -> DataFrame:
        exact = F.least("na", "nb")
        return tally.groupBy(*KEY).agg(
            F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum(exact).alias("exact"),
            F.sum(F.col("na") - exact).alias("left_a"), F.sum(F.col("nb") - exact).alias("left_b"),
            F.max(F.col("blank") & (F.col("na") != F.col("nb"))).alias("blank"),
        )

    def named(self, some: DataFrame | None = None, sides: str = "ab") -> DataFrame:
        """some (rows of groups, all if none are given) with k and raw_key: the key, normalised and
        as it came (the least of A's, or else of B's; `sides` tells which can have it)."""
        texts = reduce(DataFrame.union, [self._side(s) for s in sides]).select(*KEY, "side", "k", "raw_k")
        if some is not None:
            some = keep(some, "keys")
            texts = sieve.sift(texts, some, KEY)
        first = Window.partitionBy(*KEY).orderBy("side", "raw_k")
        # a key's texts are few, however many rows have it
        texts = texts.distinct().withColumn("_first", F.row_number().over(first)).where("_first = 1").select(*KEY, "k", F.col("raw_k").alias("raw_key"))
        return texts if some is None else some.join(texts, list(KEY))

    @property
    def _shared(self) -> Column:
        return (F.col("na") > 0) & (F.col("nb") > 0)

    @property
    def _approximate(self) -> Column:
        return self._shared & (F.greatest("left_a", "left_b") > self.exact_limit) & (F.least("left_a", "left_b") > 0)

    @property
    def _few(self) -> str:
        return f"least(left_a, left_b) > 0 and greatest(left_a, left_b) between 3 and {self.exact_limit}"

    @property
    def _many(self) -> str:
        return f"least(left_a, left_b) > 0 and greatest(left_a, left_b) > greatest(2, {self.exact_limit})"

    def key_column(self) -> Column:
        """The key's text from raw_key and k."""
        parts = [self.dialect.key_part(F.col("raw_key")[i], F.col("k")[i]) for i in range(len(self.keys))]
        return key_text(parts)

    @cached_property
    def _odd(self) -> DataFrame:
        """The rows of tally of which one side has more; only these are kept where tally isn't."""
        return self.tally.where("na <> nb") if "tally" in self.__dict__ else keep(self._tallied().where("na <> nb"), "odd")

    @cached_property
    def left(self) -> DataFrame:
        """k, side, v, raw (content), n: contents beyond the other side's count, of keys with such rows on
        both sides, with the key's counts of both sides. Told by such contents alone: the others
        have nothing left."""
        own = F.array(F.struct(F.lit("a").alias("side"), (F.col("na") - F.col("nb")).alias("n")), F.struct(F.lit("b").alias("side"), (F.col("nb") - F.col("na")).alias("n")))
        more = self._odd.select(*KEY, *CONTENT, F.explode(own).alias("x")).where("x.n > 0").select(*KEY, *CONTENT, "x.*")
        of = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0)).alias(f"left_{side}")
        g = self.named(more.groupBy(*KEY).agg(of("a"), of("b")).where("least(left_a, left_b) > 0"), "a")
        g = keep(g, "left-keys")
        # keys with very many rows left are few, and are met by broadcast; the others by shuffle
        many = F.greatest("left_a", "left_b") > HOT
        key, few = list(KEY), F.broadcast(g.where(many))
        counted = more.join(few, key).union(more.join(F.broadcast(g.where(many).select(*key)), key, "left_anti").join(g.where(~many), key))
        counted = keep(counted, "left-counts")
        # the texts of these contents: of rows that are equal by the dialect, the least as it came
        at = [*KEY, *CONTENT, "side"]
        rows = sieve.sift(self._side("a").union(self._side("b")).select(*at, "raw_k", "raw", "v"), counted, at)
        least = Window.partitionBy(*at).orderBy("raw_k", "raw")
        texts = rows.distinct().withColumn("_first", F.row_number().over(least)).where("_first = 1").select(*at, "v", "raw")
        met = counted.join(texts, at)
        return keep(met.select("k", "side", "v", "raw", "n", "left_a", "left_b", "raw_key"), "left")  # only what differs; all pairings read it

    def _one_to_one(self) -> DataFrame:
        one = self.left.where("left_a = 1 and left_b = 1")
        a, b = (one.where(F.col("side") == s).select("k", "raw_key", F.col("v").alias(f"v_{s}"), F.col("raw").alias(f"raw_{s}")) for s in "ab")
        return a.join(b.drop("raw_key"), "k").withColumn("n", F.lit(1).cast("long"))

    def _two(self) -> DataFrame:
        """Pairs of keys with two rows left on a side (and one or two on the other): the cheaper of
        the two ways to pair them."""
        of = lambda side: F.flatten(F.transform(
            F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("v", "raw", "n")))), lambda x: F.array_repeat(F.struct(x["v"].alias("v"), x["raw"].alias("raw")), x["n"].cast("int"))))
        some = self.left.where("least(left_a, left_b) > 0 and greatest(left_a, left_b) = 2").groupBy("k", "raw_key").agg(of("a").alias("a"), of("b").alias("b"))
        a, b = ([F.get(side, i) for i in (0, 1)] for side in "ab")
        cost = lambda x, y: F.aggregate(F.zip_with(x["v"], y["v"], lambda p, q: (p != q).cast("int")), F.lit(0), lambda acc, d: acc + d)
        pair = lambda x, y: F.struct(x["v"].alias("v_a"), x["raw"].alias("raw_a"), y["v"].alias("v_b"), y["raw"].alias("raw_b"))
        either = lambda p, q, x, y: F.when(p <= q, x).otherwise(y)
        both = either(cost(a[0], b[0]) + cost(a[1], b[1]), cost(a[0], b[1]) + cost(a[1], b[0]), F.array(pair(a[0], b[0]), pair(a[1], b[1])), F.array(pair(a[0], b[1]), pair(a[1], b[0])))
        found = (
            F.when(F.size("a") == 1, F.array(either(cost(a[0], b[0]), cost(a[0], b[1]), pair(a[0], b[0]), pair(a[0], b[1]))))
            .when(F.size("b") == 1, F.array(either(cost(a[0], b[0]), cost(a[1], b[0]), pair(a[0], b[0]), pair(a[1], b[0])))).otherwise(both)
        )
        return some.select("k", "raw_key", F.explode(found).alias("p")).select("k", "raw_key", "p.*").withColumn("n", F.lit(1).cast("long"))

    def _assigned(self) -> DataFrame:
        some = self.left.where(self._few)
        cols = "k array<string>, raw_key array<string>, v_a array<string>, raw_a array<string>, v_b array<string>, raw_b array<string>, n long"

        def pair(group: pd.DataFrame) -> pd.DataFrame:
            # at most `limit` rows a side by the filter above
            group = group.assign(sort=[tuple(x) for x in group["v"]]).sort_values("sort")
            sides = [group[group["side"] == s] for s in "ab"]
            sides = [x.loc[x.index.repeat(x["n"])].reset_index(drop=True) for x in sides]
            values = [np.array([list(v) for v in x["v"]], object).reshape(len(x), -1) for x in sides]
            found = assign(pair_costs(*values))
            first = group.iloc[0]
            return pd.DataFrame([(first["k"], first["raw_key"], sides[0]["v"][i], sides[0]["raw"][i], sides[1]["v"][j], sides[1]["raw"][j], 1) for i, j in found], columns=["k", "raw_key", "v_a", "raw_a", "v_b", "raw_b", "n"])

        ship(self.a.sparkSession)
        return some.groupBy("k").applyInPandas(pair, cols)

    def _zip(self, some: DataFrame, group: list[str]) -> DataFrame:
        """Pairs of the n-th row by content of one side of a group with the n-th of the other, up to
        the group's `top`, as spans of equal contents, so rows aren't multiplied out. Spans are placed
        by distributed running counts."""
        placed = keep(ranks.running_counts(some.withColumn("g", F.struct(*group, "side")), ["g"], ["v"], "n"), "in-order")
        # placed: before (rows of the group before this content) and n; spans meet where they overlap
        cut = placed.select(*group, "raw_key", "side", "v", "raw", F.col("before").alias("lo"), (F.col("before") + F.col("n")).alias("hi"), "top").where("lo < top")
        cut = cut.withColumn("hi", F.least("hi", "top"))
        # each span goes to the blocks of ranks that it touches, so a key's spans meet block by block
        width = 128
        blocks = cut.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
        a, b = (blocks.where(F.col("side") == s).select(*group, "block", "raw_key", F.col("v").alias(f"v_{s}"), F.col("raw").alias(f"raw_{s}"), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}")) for s in "ab")
        met = a.join(b.drop("raw_key"), [*group, "block"]).where("lo_a < hi_b and lo_b < hi_a")
        start = F.greatest("lo_a", "lo_b", F.col("block") * width)
        end = F.least("hi_a", "hi_b", (F.col("block") + 1) * width)
        return met.withColumn("n", end - start).where("n > 0").select(*_PAIR)

    def _in_order(self) -> DataFrame:
        """Pairs of groups beyond the limit, in order of content."""
        return self._zip(self.left.where(self._many).withColumn("top", F.least("left_a", "left_b")), ["k"])

    @cached_property
    def _ordered(self) -> DataFrame:
        """_in_order for several uses. Kept."""
        return keep(self._in_order(), "ordered")

    def _proposals(self, some: DataFrame, lost: list[tuple[int, ...]]) -> DataFrame:
        """Pairs of rows of a key that are equal but for one of the sets of columns `lost`. Each content
        chooses one such set that has partners (that with the fewest), and pairs with those on the
        other side that chose the same; so a row is taken once."""
        less = [F.struct(F.lit(i).alias("c"), *[F.xxhash64(F.lit(seed), *[F.col("v")[j] for j in range(len(self.compare)) if j not in out]).alias(f"s{seed}") for seed in (1, 2)]) for i, out in enumerate(lost)]
        each = some.select("k", "side", "v", "n", F.explode(F.array(*less)).alias("x")).select("k", "side", "v", "n", "x.*")
        at = ["k", "c", "s1", "s2"]
        of = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
        top = lambda df: df.groupBy(*at).agg(F.least(of("a"), of("b")).alias("top")).where("top > 0")
        chosen = each.join(top(each), at).groupBy("k", "side", "v").agg(F.min(F.struct("top", "c", "s1", "s2")).alias("x")).select("k", "side", "v", "x.c", "x.s1", "x.s2")
        taking = keep(some.drop("top").join(chosen, ["k", "side", "v"]), "proposals")
        return keep(self._zip(taking.join(top(taking), at), at), "alike")

    def _alike(self) -> DataFrame:
        """Pairs of groups beyond the limit: rows alike but for one column, then but for two, then in
        order. A key that has more differing cells so than in order alone is paired in order."""
        names, some, found = range(len(self.compare)), self.left.where(self._many), []
        for out in (1, 2):
            lost = list(combinations(names, out))
            for _ in range(ROUNDS[out] if len(names) > out and len(lost) <= MOST_LOST else 0):
                pairs = self._proposals(some, lost)
                if pairs.isEmpty():
                    break
                found.append(pairs)
                used = pairs.select("k", F.lit("a").alias("side"), F.col("v_a").alias("v"), F.col("n").alias("used")).union(pairs.select("k", F.lit("b"), "v_b", "n"))
                used = used.groupBy("k", "side", "v").agg(F.sum("used").alias("used"))
                rest = some.join(used, ["k", "side", "v"], "left").withColumn("n", F.col("n") - F.coalesce("used", F.lit(0))).drop("used")
                some = keep(rest.where("n > 0"), "rest")
        if not found:
            return self._in_order()
        of = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
        top = some.groupBy("k").agg(F.least(of("a"), of("b")).alias("top")).where("top > 0")
        own = self._zip(some.join(F.broadcast(top), "k"), ["k"])  # keys of over `exact_limit` rows each
        for pairs in found:
            own = own.union(pairs)
        own, ordered = keep(own, "alike"), self._ordered
        cells = lambda df, name: df.groupBy("k").agg(F.sum(differing() * F.col("n")).alias(name))
        worse = keep(cells(own, "x").join(cells(ordered, "y"), "k").where("x > y").select("k"), "worse")
        return own.join(worse, "k", "left_anti").union(ordered.join(worse, "k", "left_semi"))

    @cached_property
    def pairs(self) -> DataFrame:
        """k, raw_key, contents and raw contents of both sides, n: pairs of rows that differ."""
        own = self._one_to_one().select(*_PAIR).union(self._two().select(*_PAIR))
        for which, pairing in ((self._few, self._assigned), (self._many, self._alike)):
            if not self.left.where(which).isEmpty():
                own = own.union(pairing().select(*_PAIR))
        return keep(own, "pairs")

    def cells(self) -> DataFrame:
        """key, column, value_a, value_b (as they came) and n: how many pairs of rows differ so."""
        names = F.array(*[F.lit(c) for c in self.compare]).cast("array<string>")
        each = F.arrays_zip(names.alias("column"), F.col("v_a"), F.col("v_b"), F.col("raw_a"), F.col("raw_b"))
        rows = self.pairs.select("k", "raw_key", "n", F.explode(each).alias("x")).where("x.v_a <> x.v_b")
        return rows.select(self.key_column().alias("key"), F.col("x.column").alias("column"), F.col("x.raw_a").alias("value_a"), F.col("x.raw_b").alias("value_b"), F.col("x.v_a").alias("norm_a"), F.col("x.v_b").alias("norm_b"), "n")

    def only(self, side: str) -> DataFrame:
        """key, type (only_in_x or unmatched_x) and n: rows of side a or b without a partner."""
        mine, other = (F.col("na"), F.col("nb")) if side == "a" else (F.col("nb"), F.col("na"))
        n = mine - F.least("na", "nb")
        kind = F.when(other == 0, f"only_in_{side}").otherwise(f"unmatched_{side}")
        own = self.groups.where(n > 0).select(*KEY, kind.alias("type"), n.cast("long").alias("n"))
        return self.named(own).select(self.key_column().alias("key"), "type", "n")

    def counts(self) -> DataFrame:
        """One row of statistics that need no pairing."""
        return self._counts().drop(*_SIGNS)

    def _counts(self) -> DataFrame:
        both = self._shared
        one = both & (F.col("na") == 1) & (F.col("nb") == 1)
        dup = both & ~one
        total = lambda c, when=None: F.coalesce(F.sum(c if when is None else F.when(when, c)), F.lit(0)).cast("long")
        na, nb, least = F.col("na"), F.col("nb"), F.least("na", "nb")
        own = self._once().agg(
            total(na).alias("rows_a"), total(nb).alias("rows_b"), F.count_if(one).alias("unique_keys"), F.count_if(dup).alias("dup_keys"),
            F.count_if(self._approximate).alias("approximate_groups"), total(na, dup).alias("dup_rows_a"), total(nb, dup).alias("dup_rows_b"),
            total(least).alias("matched"), total(na, nb == 0).alias("truly_only_a"), total(nb, na == 0).alias("truly_only_b"),
            total(na - least, both).alias("dup_unmatched_a"), total(nb - least, both).alias("dup_unmatched_b"),
            total(na - least).alias("only_a"), total(nb - least).alias("only_b"), total(F.col("exact")).alias("exact"),
            F.count_if(na > 1).alias("duplicate_keys_a"), F.count_if(nb > 1).alias("duplicate_keys_b"),
            total(na, na > 1).alias("duplicate_rows_a"), total(nb, nb > 1).alias("duplicate_rows_b"),
            total(F.least("left_a", "left_b")).alias("_pairs"), F.count_if((F.least("left_a", "left_b") > 0) & F.col("blank")).alias("_blanks"),
        )
        set_a, set_b = set(self.a.columns), set(self.b.columns)
        long = lambda x: F.lit(x).cast("long")
        return own.withColumns({"cmp_cols": long(len(self.compare)), "only_cols_a": long(len(set_a - set_b)), "only_cols_b": long(len(set_b - set_a)), "ambiguous_cols": long(0)})

    def signs(self, flips: bool = True) -> DataFrame:
        """counts with diff_cells and null_flip (where asked for), of which only tells whether they are
        over zero, as verdicts ask. Rows left over on both sides of a key differ in a cell, however they
        are paired; whether a blank one is among these cells takes pairing where such rows have any."""
        own = keep(self._counts(), "signs")
        if flips and own.first()["_blanks"]:
            return self.stats()
        return own.withColumnsRenamed({"_pairs": "diff_cells", "_blanks": "null_flip"}).withColumn("null_flip", F.lit(0).cast("long"))

    def stats(self) -> DataFrame:
        """counts with diff_cells and null_flip (differing cells of which one or both are blank)."""
        self.tally  # kept, as both cells and counts are told by it
        blank = lambda c: F.col(c).isin(*BLANK)
        cells = self.cells().agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("diff_cells"),
            F.coalesce(F.sum(F.when(blank("norm_a") | blank("norm_b"), F.col("n"))), F.lit(0)).cast("long").alias("null_flip"),
        )
        return self.counts().join(cells, how="cross")  # one row by one row


def differing() -> Column:
    """How many columns of a pair (v_a, v_b) differ."""
    return F.aggregate(F.zip_with("v_a", "v_b", lambda p, q: (p != q).cast("int")), F.lit(0), lambda acc, d: acc + d)


def duplicate_keys(df: DataFrame, keys: list[str], dialect: Dialect) -> DataFrame:
    """key and n of each key that several rows have."""
    kind = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    norm = F.array(*[dialect(quoted(c), kind[c]) for c in keys])
    raw = F.array(*[quoted(c).cast("string") for c in keys])
    g = df.select(norm.alias("k"), raw.alias("raw")).groupBy("k").agg(F.count("*").alias("n"), F.min("raw").alias("raw_key")).where("n > 1")
    return g.select(key_text([dialect.key_part(F.col("raw_key")[i], F.col("k")[i]) for i in range(len(keys))]).alias("key"), "n")


def log_rows(diff: KeyedDiff) -> DataFrame:
    """level, reason, key, column, n: the findings of a result diff. The reasons are codes."""
    diff.tally  # kept, as both cells and rows are told by it
    cells = diff.cells()
    kind = lambda c: F.when(F.col(c) == "null|", "null").when(F.col(c) == "empty|", "empty")
    a, b = kind("norm_a"), kind("norm_b")
    reason = F.when(a.isNotNull() & b.isNotNull(), "blank_kinds").when(a.isNotNull(), F.concat(F.lit("a_"), a)).when(b.isNotNull(), F.concat(F.lit("b_"), b)).otherwise("value")
    level = F.when(reason == "value", "mid").otherwise("high")
    out = cells.select(level.alias("level"), reason.alias("reason"), "key", "column", "n")
    # a key's findings of rows are told in one pass over the keys that have any
    least = F.least("na", "nb")
    found = [F.when(F.col(mine) > least, F.struct(F.when(F.col(other) == 0, f"only_in_{s}").otherwise(f"unmatched_{s}").alias("reason"), (F.col(mine) - least).alias("n"))) for s, mine, other in (("a", "na", "nb"), ("b", "nb", "na"))]
    found += [F.when(F.col(f"n{s}") > 1, F.struct(F.lit(f"duplicate_key_{s}").alias("reason"), F.col(f"n{s}").alias("n"))) for s in "ab"]
    some = diff.groups.where("na <> nb or na > 1 or nb > 1").select(*KEY, F.filter(F.array(*found), lambda x: x.isNotNull()).alias("found"))
    rows = diff.named(some).select(diff.key_column().alias("key"), F.explode("found").alias("x"))
    return out.union(rows.select(F.lit("high"), "x.reason", "key", F.lit(""), F.col("x.n").cast("long")))


def keys_in_scope(diff: KeyedDiff, most_diffs: int | None = None, most_only: int | None = None) -> DataFrame:
    """key: those of which all differences are known, so that they may be closed in a ledger. That is
    all keys of both sides, unless the caller passes on only the first most_diffs cells or most_only
    rows of each side (by key and column): then keys with more than that are left out."""
    keys = diff.named().select(diff.key_column().alias("key"))
    cut = [ranks.beyond(diff.cells(), most_diffs, ["key", "column"]).select("key")] if most_diffs is not None else []
    cut += [ranks.beyond(diff.only(side), most_only, ["key"]).select("key") for side in "ab" if most_only is not None]
    for late in cut:
        keys = keys.join(late.distinct(), "key", "left_anti")
    return keys
