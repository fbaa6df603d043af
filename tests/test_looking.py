"""Samples, keys, empty results, the ledger's store."""

import pytest
from pyspark.sql import functions as F

from reckon import api
from reckon.operators import catalog, key_guess, ledger, ledger_store, sampling
from reckon.operators.keyed_diff import KeyedDiff
from reckon.plans import empties


def test_samples_draw_the_same_keys(spark):
    a = spark.range(3000).selectExpr("id", "id % 10 as v", "'x' as h")
    b = a.where("id >= 400").withColumn("v", F.when(F.col("id") % 20 == 0, -1).otherwise(F.col("v")))
    drawn = sampling.draw(a, b, ["id"], 500)
    ids = [{r["id"] for r in df.collect()} for df in (drawn.a, drawn.b)]
    assert len(ids[0]) == 500 and ids[1] == {i for i in ids[0] if i >= 400} and drawn.a.columns == a.columns
    got = sampling.share(KeyedDiff(drawn.a, drawn.b, ["id"])).first()
    true = (400 + 130) / 3000
    assert got["keys"] == 500 and got["low"] <= true <= got["high"] and got["high"] - got["low"] < 0.1
    out = api.table_diff(a, b, ["id"], limit=500)
    assert out["sampled"] and out["share"].first()["keys"] == 500 and "sample_only" in out["sample"].verdict.first()["cause"] and out["sample"].scope.count() == 0
    whole = api.table_diff(a, b, ["id"], limit=5000)
    assert not whole["sampled"] and whole["share"].first()["differing"] == 530
    assert sampling.share(KeyedDiff(a.limit(0), b.limit(0), ["id"])).first()["share"] == 0


def test_composite_keys(spark):
    df = spark.range(600).selectExpr("id div 6 as `a.b`", "id % 6 as c", "id % 2 as d", "cast(null as int) as e", "id % 6 div 2 as f")
    assert sorted(r["columns"] for r in key_guess.composite_keys(df).collect()) == ["a.b,c", "a.b,d,f"]
    one = df.withColumn("k", F.monotonically_increasing_id())
    assert [r["columns"] for r in key_guess.composite_keys(one, 1).collect()] == ["k"]
    assert key_guess.composite_keys(df.union(df)).count() == 0 and key_guess.composite_keys(df.limit(0)).count() == 0


def test_near_keys_are_disproved_together(spark, monkeypatch):
    """Sets that all but tell rows apart are disproved in one pass, so only keys are counted over all rows;
    nulls, and values that have one hash, are still told apart."""
    counted = []
    of = key_guess._is_key
    monkeypatch.setattr(key_guess, "_is_key", lambda df, s: counted.append(s) or of(df, s))
    df = spark.range(20000).selectExpr("id div 2 as a", "id % 19000 as b", "(id * 7) % 19500 as c", "id % 2 as d")
    assert [r["columns"] for r in key_guess.composite_keys(df).collect()] == ["a,b", "a,c", "a,d", "b,c"]
    assert set(counted) == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c")}
    nulls = spark.createDataFrame([(None, 1), (1, None), (1, 1)], "a int, b int")
    assert of(nulls, ("a", "b")) and not of(nulls.union(nulls.limit(1)), ("a", "b"))


def test_only_likely_columns_are_counted(spark):
    a = spark.range(2000).selectExpr("id as order_id", "id % 3 as x", "id % 5 as y", "id % 7 as z", "id % 2 as w", "id % 11 as q", "concat('t', id div 2) as t")
    got = {r["column"]: r["unique_rate"] for r in key_guess.guess_keys(a, a).collect()}
    assert list(got)[:2] == ["order_id", "t"] and got["order_id"] == 1 and got["t"] == 0.5 and len(got) == 4
    assert key_guess.guess_keys(a.limit(0), a).count() == 0


def test_why_a_result_is_empty(spark):
    spark.range(100).selectExpr("id", "id % 4 as p").createOrReplaceTempView("e_t")
    rows = lambda sql: [(r["condition"], r["rows_in"], r["alone"], r["kept"], r["without"], r["cause"]) for r in empties.steps(spark, sql).collect()]
    assert rows("SELECT * FROM e_t WHERE id > 10 AND p = 7 AND id < 50") == [("(id > 10)", 100, 89, 89, 0, False), ("(p = 7)", 100, 0, 0, 39, True), ("(id < 50)", 100, 50, 0, 0, False)]
    both = rows("SELECT a.id FROM e_t a JOIN (SELECT id + 1000 AS id FROM e_t WHERE p = 1) b ON a.id = b.id WHERE a.p = 0")
    assert [r[-1] for r in both] == [False, True, False] and both[1][1:4] == (100, 25, 0)
    part = rows("WITH w AS (SELECT p, count(*) AS n FROM e_t WHERE id >= 0 GROUP BY p HAVING n > 90) SELECT * FROM w WHERE p IN (SELECT p FROM e_t)")
    assert [r[-1] for r in part] == [False, True, False]
    spark.range(5).selectExpr("id", "timestamp_ntz'2024-01-01' as ts").createOrReplaceTempView("e_u")
    found = api.query_diff(spark, "SELECT id, ts FROM e_u", "SELECT id, ts FROM e_u WHERE id > 77", ["id"], "ts", "2024-01-01", "2024-01-02")
    assert [r["condition"] for r in found.notes["emptied"].where("cause").collect()] == ["(id > 77)"]


def test_a_round_writes_only_its_buckets(spark, tmp_path):
    store = ledger_store.Store(spark, f"{tmp_path}/ledger")
    assert store.entries().count() == 0 and store.rounds() == []
    diffs = lambda ids: spark.createDataFrame([(str(i), "c", "1", "2", "diff") for i in ids], ledger.DIFF_SCHEMA)
    pks = lambda ids: spark.createDataFrame([(str(i),) for i in ids], "pk string")
    assert store.merge(0, diffs(range(300)), pks([]), "r1") > 200
    before = store.manifest()
    assert 1 <= store.merge(1, diffs(range(5)), pks(range(10)), "r2") <= 10
    changed = {b for b, f in store.manifest().items() if before.get(b) != f}
    assert len(changed) <= 10 and store.merge(1, diffs([7]), pks([]), "again") == 0
    want = ledger.merge(ledger.merge(spark.createDataFrame([], ledger.SCHEMA), diffs(range(300)), pks([]), "r1"), diffs(range(5)), pks(range(10)), "r2")
    rows = lambda df: sorted(map(str, df.select(*[x.split()[0] for x in ledger.SCHEMA.split(", ")]).collect()))
    assert rows(store.entries()) == rows(want) and store.entries(0).where("last_seen = 'r2'").count() == 0
    assert store.vacuum() == len(changed) and rows(store.entries()) == rows(want)


def test_counts_read_no_column(spark, tmp_path):
    spark.range(500).write.parquet(f"{tmp_path}/t.parquet")
    counted = catalog.row_counts({"t": spark.read.parquet(f"{tmp_path}/t.parquet")})
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan and counted.first()["rows"] == 500


@pytest.mark.parametrize("most", [1, 50])
def test_a_sample_of_few_keys(spark, most):
    a = spark.createDataFrame([(None, 1), (None, 1), ("x", 2)], "h string, v int")
    drawn = sampling.draw(a, a, ["h"], most)
    assert drawn.whole == (most == 50) and drawn.a.count() in (1, 2, 3) and drawn.a.count() == drawn.b.count()
