"""Keyed differences: equality, duplicate keys, verdicts, scope; held to brute force."""

import itertools
import random

import numpy as np
import pytest

from reckon.functions.cells import FileDialect, SqlDialect, name_hit
from reckon.operators import keyed_diff, ledger, ranks, verdicts
from reckon.operators.assignment import assign, pair_costs
from reckon.operators.keyed_diff import DiffError, KeyedDiff
from reckon.streaming import ledger_stream


def frame(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def diff(spark, a, b, keys=("id",), cols=("id", "value"), dialect=FileDialect()):
    return KeyedDiff(frame(spark, cols, a), frame(spark, cols, b), list(keys), dialect)


def verdict(d, of=verdicts.file_verdict):
    r = of(d.stats()).first()
    return r["level"], r["cause"]


def test_assignment_is_least():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, m = map(int, rng.integers(1, 6, 2))
        c = rng.integers(0, 5, (n, m))
        p = assign(c)
        assert len(p) == min(n, m) == len({i for i, _ in p}) == len({j for _, j in p})
        turned = c if n <= m else c.T
        best = min(sum(turned[i, j] for i, j in enumerate(q)) for q in itertools.permutations(range(max(n, m)), min(n, m)))
        assert sum(c[i, j] for i, j in p) == best


def test_equal_and_one_cell(spark):
    d = diff(spark, [("1", "x"), ("2", "y")], [("2", "y"), ("1", "x")])
    assert verdict(d) == ("ok", "equal") and d.cells().count() == 0
    d = diff(spark, [("1", "x"), ("2", "y")], [("1", "x"), ("2", "z")])
    assert verdict(d) == ("diff", "cells")
    assert [(r["key"], r["column"], r["value_a"], r["value_b"]) for r in d.cells().collect()] == [("2", "value", "y", "z")]


def test_duplicates_pair_by_content(spark):
    d = diff(spark, [("1", "x"), ("1", "y")], [("1", "y"), ("1", "x")])
    assert d.stats().first()["diff_cells"] == 0 and verdict(d) == ("warn", "duplicate_keys")
    d = diff(spark, [("1", "x"), ("1", "y")], [("1", "x")])
    s = d.stats().first()
    assert (s["only_a"], s["dup_unmatched_a"], s["matched"]) == (1, 1, 1) and verdict(d)[0] == "diff"
    assert [tuple(r) for r in d.only("a").collect()] == [("1", "unmatched_a", 1)]


def test_kinds_of_blank(spark):
    for other in ("", "NULL", "NONE"):
        d = diff(spark, [("1", None)], [("1", other)], dialect=SqlDialect())
        s = d.stats().first()
        assert (s["diff_cells"], s["null_flip"]) == (1, 1), other
        assert diff(spark, [("1", None)], [("1", other)]).stats().first()["diff_cells"] == 0


def test_zero_padding(spark):
    d = diff(spark, [("001", "x")], [("1", "x")], dialect=SqlDialect())
    assert d.stats().first()["only_a"] == 1
    assert diff(spark, [("1", "001")], [("1", "1")], dialect=SqlDialect()).stats().first()["diff_cells"] == 1
    assert diff(spark, [("1", "1.50")], [("1", "15e-1")], dialect=SqlDialect()).stats().first()["diff_cells"] == 0


def test_sql_numbers_are_exact(spark):
    cases = {
        "1": "number|1", "+1.0": "number|1", "-0": "number|0", "0.0e5": "number|0", "1e3": "number|1000", "12.50": "number|12.5", ".5": "number|0.5", "5.": "number|5", "-1.2E-3": "number|-0.0012",
        "1" * 40 + ".5": "number|" + "1" * 40 + ".5", "1,000": "text|1,000", "007": "text|007", "+007": "text|+007", "0.70": "number|0.7", "NaN": "text|NaN", " 3 ": "number|3", "": "empty|", " ": "empty|", "1e": "text|1e",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r[0]: r[1] for r in df.select("v", SqlDialect()(df["v"])).collect()}
    assert got == cases


def test_file_options(spark):
    df = spark.createDataFrame([(" Ab ", "1.50", "null")], "a string, b string, c string")
    norm = lambda d: tuple(df.select(d(df["a"]), d(df["b"]), d(df["c"])).first())
    assert norm(FileDialect()) == ("ab", "1.5", "")
    assert norm(FileDialect(case_sensitive=True)) == ("Ab", "1.5", "")
    assert norm(FileDialect(trim_whitespace=False)) == (" ab ", "1.5", "")
    assert norm(FileDialect(null_equals_empty=False)) == ("ab", "1.5", "null")
    assert norm(FileDialect(strict_numeric=True)) == ("ab", "1.50", "")


def test_structures_and_errors(spark):
    a, b = frame(spark, ("id", "old"), [("1", "x")]), frame(spark, ("id", "new"), [("1", "x")])
    d = KeyedDiff(a, b, ["id"])
    s = d.stats().first()
    assert s["cmp_cols"] == 0 and verdict(d) == ("diff", "structure")
    assert verdict(KeyedDiff(a.select("id"), b.select("id"), ["id"])) == ("warn", "key_only")
    assert verdict(diff(spark, [], [])) == ("warn", "empty")
    assert verdict(diff(spark, [], [], dialect=SqlDialect()), verdicts.sql_verdict) == ("warn", "empty")
    twice = spark.createDataFrame([(1, 2)], "id int, x int").toDF("id", "ID ")
    with pytest.raises(DiffError):
        KeyedDiff(twice, b, ["id"])
    with pytest.raises(DiffError):
        KeyedDiff(a, b, ["none"])


def test_composite_keys_keep_their_parts(spark):
    a = frame(spark, ("k1", "k2", "v"), [("a+b", "c", "1"), ("a", "b+c", "1")])
    d = KeyedDiff(a, a.limit(0), ["k1", "k2"], SqlDialect())
    assert {r["key"] for r in d.only("a").collect()} == {'["a+b","c"]', '["a","b+c"]'}


def test_large_groups_are_approximate(spark):
    d = diff(spark, [("1", f"a{i:03}") for i in range(250)], [("1", f"b{i:03}") for i in range(250)])
    s = d.stats().first()
    assert (s["approximate_groups"], s["matched"], s["diff_cells"]) == (1, 250, 250)
    d = diff(spark, [("1", f"a{i // 3:03}") for i in range(900)], [("1", f"b{i // 2:03}") for i in range(400)])
    s = d.stats().first()
    assert (s["matched"], s["only_a"], s["diff_cells"]) == (400, 500, 400)


def brute(a, b, keys):
    """Matched rows and least total of differing cells of small tables."""
    total = matched = 0
    norm = lambda v: (v or "").strip().lower()
    for k in {norm(r[0]) for r in a} & {norm(r[0]) for r in b}:
        x = [[norm(v) for v in r[1:]] for r in a if norm(r[0]) == k]
        y = [[norm(v) for v in r[1:]] for r in b if norm(r[0]) == k]
        if len(x) > len(y):
            x, y = y, x
        total += min(sum(sum(p != q for p, q in zip(r, y[j])) for r, j in zip(x, order)) for order in itertools.permutations(range(len(y)), len(x)))
        matched += len(x)
    return matched, total


def test_random_tables_as_brute_force_and_mirrored(spark):
    rng = random.Random(3)
    for _ in range(3):
        row = lambda: (str(rng.randint(0, 8)), rng.choice(["x", "y", " X", None, ""]), rng.choice("pqr"))
        a, b = [row() for _ in range(28)], [row() for _ in range(25)]
        d, m = diff(spark, a, b, cols=("id", "v", "w")), diff(spark, b, a, cols=("id", "v", "w"))
        s, t = d.stats().first(), m.stats().first()
        assert (s["matched"], s["diff_cells"]) == brute(a, b, 1)
        assert (s["only_a"], s["only_b"], s["diff_cells"]) == (t["only_b"], t["only_a"], t["diff_cells"])
        assert diff(spark, a, a[::-1], cols=("id", "v", "w")).stats().first()["diff_cells"] == 0


def test_wide_rows_and_scope(spark):
    n = 60
    cols = ["id"] + [f"c{i}" for i in range(n)]
    a = frame(spark, cols, [tuple(["1"] + ["x"] * n), tuple(["2"] + ["x"] * n)])
    b = frame(spark, cols, [tuple(["1"] + ["y"] * n), tuple(["2"] + ["x"] * n)])
    d = KeyedDiff(a, b, ["id"])
    assert d.stats().first()["diff_cells"] == n
    assert [r[0] for r in keyed_diff.keys_in_scope(d, most_diffs=50).collect()] == ["2"]
    assert {r[0] for r in keyed_diff.keys_in_scope(d).collect()} == {"1", "2"}


def test_qualifiers_only_lower(spark):
    d = diff(spark, [("1", "x")], [("1", "x")])
    ok = verdicts.file_verdict(d.stats())
    assert verdicts.sampled(ok).first()["level"] == "warn" and verdicts.incomplete(ok, 0).first()["level"] == "ok"
    assert verdicts.incomplete(verdicts.sampled(ok), 2).first()["level"] == "warn"
    bad = verdicts.file_verdict(diff(spark, [("1", "x")], [("1", "y")]).stats())
    assert verdicts.sampled(bad).first()["level"] == "diff"


def test_logs(spark):
    d = diff(spark, [("1", None), ("2", "x"), ("3", ""), ("4", "q"), ("4", "r")], [("1", "x"), ("2", "y"), ("3", None)], dialect=SqlDialect())
    got = {(r["level"], r["reason"], r["key"]) for r in keyed_diff.log_rows(d).collect()}
    assert got == {("high", "a_null", "1"), ("mid", "value", "2"), ("high", "blank_kinds", "3"), ("high", "only_in_a", "4"), ("high", "duplicate_key_a", "4")}


def test_running_counts(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.randint(0, 1000), rng.randint(1, 4)) for _ in range(400)]
    got = ranks.running_counts(spark.createDataFrame(rows, "g string, x int, n int"), ["g"], ["x", "n"], "n").collect()
    for g in "ab":
        mine = sorted((r["x"], r["n"], r["before"]) for r in got if r["g"] == g)
        total = 0
        for x, n, before in sorted(mine, key=lambda r: r[2]):
            assert before == total
            total += n
        assert [r[:2] for r in mine] == sorted(r[1:] for r in rows if r[0] == g)


def test_ledger_rounds(spark):
    scope = frame(spark, ("pk",), [("1",)])
    one = spark.createDataFrame([("1", "amount", "1", "2", "diff")], ledger.DIFF_SCHEMA)
    none, book, states = one.limit(0), spark.createDataFrame([], ledger.SCHEMA), []
    for i, d in enumerate((one, none, one, none)):
        book = ledger.merge(book, d, scope, f"r{i}")
        states.append(book.first()["state"])
    assert states == [ledger.OPEN, ledger.FIXED, ledger.BACK, ledger.FIXED]
    kept = ledger.merge(ledger.merge(spark.createDataFrame([], ledger.SCHEMA), one, scope, "r0"), none, scope.limit(0), "r1").first()
    assert kept["state"] == ledger.OPEN and kept["last_seen"] == "r0"
    with pytest.raises(ValueError):
        ledger.merge(book, one, scope, "")


def test_ledger_of_a_stream(spark, tmp_path):
    schema = ledger.DIFF_SCHEMA + ", round string"
    for i, rows in enumerate(([("1", "c", "a", "b", "diff", "r0"), ("2", "c", "a", "b", "diff", "r0")], [("1", "", None, None, "", "r1"), ("2", "c", "a", "x", "diff", "r1")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ledger_stream.start(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check", 16).awaitTermination()
        assert ledger_stream.current(spark, f"{tmp_path}/out").count() == 2, i
    got = {r["pk"]: (r["state"], r["b"]) for r in ledger_stream.current(spark, f"{tmp_path}/out").collect()}
    assert got == {"1": (ledger.FIXED, "b"), "2": (ledger.OPEN, "x")}


def test_name_hits():
    assert name_hit("user_id", ("id",)) and not name_hit("note", ("no",)) and name_hit("订单编号", ("编号",)) and name_hit("subtotal", ("total",)) and not name_hit("paid", ("id",))


def test_pair_costs():
    a, b = np.array([["x", "y"]], object), np.array([["x", "z"], ["q", "r"]], object)
    assert pair_costs(a, b).tolist() == [[1, 2]]


def _pairs_are_sound(d, a, b):
    """Every pair has rows of both sides, each as often as it is there at most, and none are equal."""
    from collections import Counter

    rows = [r for r in d._alike().collect()]
    assert all(r["v_a"] != r["v_b"] and r["n"] > 0 for r in rows)
    for side, df in (("a", a), ("b", b)):
        left = Counter()
        for r in d.left.where(f"side = '{side}'").collect():
            left[tuple(r["k"]), tuple(r["v"])] += r["n"]
        used = Counter()
        for r in rows:
            used[tuple(r["k"]), tuple(r[f"v_{side}"])] += r["n"]
        assert all(left[k] >= n for k, n in used.items())
    return sum(r["n"] for r in rows), sum(r["n"] * sum(x != y for x, y in zip(r["v_a"], r["v_b"])) for r in rows)


def test_large_groups_pair_by_likeness(spark):
    import random

    rng = random.Random(1)
    base = [(f"k{i % 2}", f"c{rng.randint(0, 400):04}", f"d{rng.randint(0, 30)}", f"e{i}") for i in range(160)]
    changed = [(k, f"z{rng.randint(0, 999)}" if rng.random() < 0.3 else c, d if rng.random() < 0.8 else "x", e if rng.random() < 0.7 else "y") for k, c, d, e in base]
    a, b = (spark.createDataFrame(x, "id string, c string, d string, e string") for x in (base + base[:20], changed[:140]))
    d = KeyedDiff(a, b, ["id"], FileDialect(), exact_limit=5)
    n, cells = _pairs_are_sound(d, a, b)
    ordered = d._in_order().collect()
    in_order = sum(r["n"] * sum(x != y for x, y in zip(r["v_a"], r["v_b"])) for r in ordered)
    assert n == sum(r["n"] for r in ordered) and cells < in_order
    assert d.counts().first()["approximate_groups"] == 2


def test_diffs_sort_nothing_to_count(spark):
    a = spark.range(50).selectExpr("id % 7 as `k``y.x`", "id as v")
    d = KeyedDiff(a, a.where("v > 3"), ["k`y.x"], FileDialect())
    plan = d.counts()._jdf.queryExecution().executedPlan().toString() + d._side("a").union(d._side("b")).groupBy("hk1", "hv1").count()._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert {r["key"] for r in d.only("a").collect()} == {"0", "1", "2", "3"}


def test_all_keys_are_in_scope_unless_cut(spark):
    a = spark.range(40).selectExpr("cast(id as string) as id", *[f"'x' as c{i}" for i in range(4)])
    b = spark.range(40).selectExpr("cast(id as string) as id", *[f"'y' as c{i}" for i in range(4)])
    d = KeyedDiff(a, b, ["id"])
    assert keyed_diff.keys_in_scope(d).count() == 40
    assert keyed_diff.keys_in_scope(d, most_diffs=10).count() == 2


def test_verdicts_are_told_by_counts_alone(spark, monkeypatch):
    """No rows are paired for a verdict, unless blank cells of rows left over may decide."""
    of = lambda rows: spark.createDataFrame(rows, "k int, v string, w string")
    whole = of([(1, "a", "x"), (1, "b", "x"), (2, "c", "y"), (3, "d", None)])
    paired = []
    stats = KeyedDiff.stats
    monkeypatch.setattr(KeyedDiff, "stats", lambda self: paired.append(1) or stats(self))
    for b, pairs, cause in (
        (of([(1, "a", "x"), (1, "b", "x"), (2, "z", "y"), (3, "d", None)]), False, "values"), (of([(1, "a", "x"), (1, "b", "x"), (2, "c", None), (3, "d", None)]), True, "null_flip"),
    ):
        d = KeyedDiff(whole, b, ["k"], SqlDialect())
        paired.clear()
        got = verdicts.sql_verdict(d.signs()).first()
        assert bool(paired) == pairs and tuple(got) == ("diff", cause)
        paired.clear()
        got = verdicts.file_verdict(KeyedDiff(whole, b, ["k"]).signs(flips=False)).first()
        assert not paired and tuple(got) == ("diff", "cells")


def test_texts_are_fetched_for_what_differs_alone(spark, monkeypatch):
    """Rows that both sides share are held back by a filter before the shuffle that fetches texts; the pairs
    are the same as without a filter."""
    from reckon.operators import sieve

    a = spark.range(3000).selectExpr("id", "cast(id % 7 as string) as v", "'x' as w")
    b = a.selectExpr("id", "case when id % 10 = 0 then 'z' else v end as v", "case when id % 15 = 0 then null else w end as w")
    got = []
    for few in (sieve.FEW, 10):
        monkeypatch.setattr(sieve, "FEW", few)
        got.append(sorted(map(tuple, KeyedDiff(a, b, ["id"]).cells().collect())))
    assert got[0] == got[1] and len(got[0]) == 500
    some = a.where("id % 10 = 0").select("id")
    passed = sieve.sift(a, some, ["id"])
    assert some.join(passed, "id", "left_anti").isEmpty() and passed.count() < 300 + 300


def test_keys_without_rows_left_on_both_sides_are_not_paired(spark):
    d = diff(spark, [("1", "x"), ("1", "y"), ("2", "x"), ("3", "p"), ("3", "q")], [("1", "x"), ("3", "p"), ("3", "r")])
    assert {r["k"][0] for r in d.left.collect()} == {"3"}
    assert (d.stats().first()["matched"], d.stats().first()["diff_cells"]) == (3, 1)


def test_logs_name_keys_in_one_pass(spark, monkeypatch):
    named = []
    of = KeyedDiff.named
    monkeypatch.setattr(KeyedDiff, "named", lambda self, *x: named.append(1) or of(self, *x))
    d = diff(spark, [("1", "x"), ("2", "x"), ("2", "x"), ("5", "n")], [("1", "y"), ("2", "x"), ("4", "q"), ("4", "q"), ("5", "n")], dialect=SqlDialect())
    got = {(r["level"], r["reason"], r["key"], r["n"]) for r in keyed_diff.log_rows(d).collect()}
    assert got == {("mid", "value", "1", 1), ("high", "unmatched_a", "2", 1), ("high", "duplicate_key_a", "2", 2), ("high", "only_in_b", "4", 2), ("high", "duplicate_key_b", "4", 2)}
    assert len(named) == 2  # of rows left over, and of the findings


def test_pairs_in_order_are_made_once(spark, tmp_path, monkeypatch):
    """likeness_pairing holds pairs by likeness against those in order, which pairing by likeness asks for too."""
    import duckdb

    from reckon import queries

    at = str(tmp_path / "lineitem.parquet")
    duckdb.sql(f"""COPY (SELECT i AS l_orderkey, i % 2000 AS l_partkey, 1 AS l_linenumber, CAST(i % 7 AS DOUBLE) AS l_quantity, 900 + i / 4 AS l_extendedprice, 'NA'[1 + i // 2000 % 2] AS l_returnflag FROM range(30000) t(i)) TO '{at}'""")
    made = []
    of = KeyedDiff._in_order
    monkeypatch.setattr(KeyedDiff, "_in_order", lambda self: made.append(1) or of(self))
    want = duckdb.sql(queries.SQL["likeness_pairing"].replace("FROM lineitem", f"FROM '{at}'")).fetchall()
    got = queries.likeness_pairing(spark, str(tmp_path)).collect()
    assert want and sorted(map(tuple, got)) == sorted(want)
    assert len(made) == 1
