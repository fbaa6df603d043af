"""Rows fetched by slices from a database and from tables, and the account of them."""

import pytest

from reckon import api
from reckon.functions.cells import SqlDialect, kind_of
from reckon.operators import verified
from reckon.sources import jdbc

URL = "jdbc:derby:memory:reckon"


@pytest.fixture(scope="module")
def connection(spark):
    """An in-process database with a table of 300 rows over three days, four of them without a time."""
    rows = spark.sql("select id, if(id % 80 = 7, null, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, int(id * 13), 0)) as ts, id % 5 as v from range(300)")
    rows.write.jdbc(f"{URL};create=true", "EV", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    return jdbc.Connection(URL, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")


def test_slices_of_a_database(spark, connection):
    source = verified.Table(spark, connection, "EV")
    got = verified.fetch(source, "ts", 40)
    account = got.account.first()
    assert (account["planned"], account["fetched"], account["mismatched"], account["complete"]) == (300, 300, 0, True)
    slices = got.slices.collect()
    assert sum(r["slice"] == verified.UNTIMED for r in slices) == 1 and len(slices) > 7 and all(r["n"] == r["got"] <= 40 for r in slices)
    assert sorted(r[0] for r in got.rows.select("id").collect()) == list(range(300)) and got.rows.columns == ["id", "ts", "v"]


def test_a_database_that_loses_rows(spark, connection):
    class Lags(verified.Table):
        """Plans on the whole table, and reads one that lacks rows."""

        def rows(self, column, slices):
            return verified.Table(self.spark, self.connection, "(SELECT * FROM EV WHERE NOT (\"id\" BETWEEN 100 AND 105)) x").rows(column, slices)

    whole = verified.Table(spark, connection, "EV")
    good = api.source_diff(whole, whole, ["id"], "ts", 50)
    assert good.verdict.first()["level"] == "ok" and good.scope.count() == 300
    bad = api.source_diff(whole, Lags(spark, connection, "EV"), ["id"], "ts", 50)
    assert "scan_incomplete" in bad.verdict.first()["cause"] and bad.scope.count() == 0
    b = bad.notes["fetched"]["b"]
    assert b.account.first()["planned"] - b.account.first()["fetched"] == 6 and 1 <= b.account.first()["mismatched"] <= 2


def test_tables_with_odd_columns(spark):
    df = spark.sql("select id as slice, 'x' as `at`, if(id = 3, null, date_format(timestamp'2024-01-01' + make_interval(0, 0, 0, int(id)), if(id % 2 = 0, 'yyyyMMdd', 'yyyy-MM-dd'))) as `d``ay` from range(20)")
    got = verified.fetch(verified.Frame(df), "d`ay", 6)
    assert got.rows.columns == df.columns and sorted(map(str, got.rows.collect())) == sorted(map(str, df.collect()))
    assert got.account.first()["complete"] and got.slices.count() == 5
    none = verified.fetch(verified.Frame(df.limit(0)), "d`ay", 6)
    assert none.account.first()["complete"] and none.rows.count() == 0


def test_query_diff_takes_texts_as_times(spark):
    spark.sql("select id, date_format(timestamp'2024-01-01' + make_interval(0, 0, 0, int(id)), 'yyyyMMdd') as day from range(20)").createOrReplaceTempView("by_day")
    found = api.query_diff(spark, "(SELECT id, day FROM by_day)", "SELECT id, day FROM by_day WHERE id <> 5", ["id"])
    assert found.verdict.first()["level"] == "diff" and found.scope.count() == 20
    found = api.source_diff(verified.Frame(spark.table("by_day")), verified.Frame(spark.table("by_day")), ["id"], "day", 3)
    assert found.verdict.first()["level"] == "ok" and found.notes["fetched"]["a"].account.first()["planned"] == 20


def test_a_gap_is_one_in_however_many_slices(spark):
    """Rows of one hour are lost; the hour is one slice, or is cut into several; rows without a time are no neighbours."""
    df = spark.sql("select id, if(id % 100 = 99, null, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 18)) as ts from range(2000)")

    class Loses(verified.Frame):
        def rows(self, column, slices):
            return verified.Frame(self.df.where(lost)).rows(column, slices)

    for lost, batch, many, gaps in (
        ("coalesce(hour(ts) <> 3, true)", 200, False, 1), ("coalesce(hour(ts) <> 3, true)", 20, True, 1), ("coalesce(hour(ts) not in (3, 6), true)", 20, True, 2),
        ("coalesce(hour(ts) > 0, false)", 20, True, 2), ("true", 20, False, 0),
    ):
        account = verified.fetch(Loses(df), "ts", batch).account.first()
        assert account["gaps"] == gaps and (account["mismatched"] > gaps) == many and account["complete"] == (gaps == 0)


def test_verified_fetch_by_its_sql_when_an_hour_is_several_slices(spark, tmp_path):
    import duckdb

    from reckon import queries

    at = str(tmp_path / "events.parquet")
    duckdb.sql(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-10 02:00:00' + i * INTERVAL 600 MILLISECOND AS ts FROM range(18000) t(i)) TO '{at}'")
    want = duckdb.sql(queries.SQL["verified_fetch"].replace("FROM events", f"FROM '{at}'")).fetchall()
    assert sorted(map(tuple, queries.verified_fetch(spark, str(tmp_path)).collect())) == sorted(want)


def test_a_comparison_is_told_by_counts(spark, monkeypatch):
    """Verdicts of comparisons pair no rows and make no statistics; times and reals are normalised by plain expressions."""
    from reckon.operators.keyed_diff import KeyedDiff

    df = spark.sql("select id, timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) as ts, id / 4 as x from range(60)")
    made = []
    of = KeyedDiff.stats
    monkeypatch.setattr(KeyedDiff, "stats", lambda self: made.append(1) or of(self))
    found = api.source_diff(verified.Frame(df), verified.Frame(df.where("id <> 5")), ["id"], "ts", 20)
    assert tuple(found.verdict.first()) == ("diff", "lost_in_b") and found.scope.count() == 60 and not made
    assert (found.stats.first()["only_a"], found.stats.first()["ambiguous_cols"], len(made)) == (1, 0, 1)
    assert "transform" not in df.select(found.diff.dialect(df["ts"], kind_of(df.schema["ts"].dataType)))._jdf.queryExecution().optimizedPlan().toString()


def test_times_and_reals_as_results(spark):
    df = spark.sql("""select * from values (1, 0.0D, date'2024-01-02', timestamp_ntz'2024-01-02 03:04:05.600'), (2, -0.0D, null, null), (3, -0.5D, date'0001-01-01', timestamp_ntz'0001-01-01'),
     (4, 100.0D, null, null), (5, 1e20D, null, null), (6, 1.5e-7D, null, null), (7, double('NaN'), null, null), (8, null, null, null), (9, 29.27D, null, null) as t(id, x, d, ts)""")
    d = SqlDialect()
    got = {r[0]: tuple(r)[1:] for r in df.select("id", *[d(df[c], kind_of(df.schema[c].dataType)) for c in ("x", "d", "ts")]).collect()}
    assert [got[i][0] for i in range(1, 10)] == ["number|0", "number|0", "number|-0.5", "number|100", "number|100000000000000000000", "number|0.00000015", "text|NaN", "null|", "number|29.27"]
    assert got[1][1:] == ("text|2024-01-02", "text|2024-01-02 03:04:05.6") and got[2][1:] == ("null|", "null|") and got[3][1:] == ("text|0001-01-01", "text|0001-01-01 00:00:00")
