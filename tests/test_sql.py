"""SQL texts: structure, logic, guard, rewrites; time slices; names; catalogs."""

import pytest

from reckon import api
from reckon.operators import catalog, naming, slicing
from reckon.plans import catalyst, guard, logic, rewrite, scopes, structure


def test_comments_and_dialect():
    assert catalyst.strip_comments("select '--x' -- y\n, 1 /* z */ --w") == "select '--x'  \n, 1   --w"
    assert catalyst.dialect("select 金额 as `数` from t where x = '金额' and y = @v;") == "select `金额` as `数` from t where x = '金额' and y = var_v"


def test_structure(spark):
    s = structure.structure(spark, "WITH c AS (SELECT a FROM x) SELECT DISTINCT t.a, EXTRACT(YEAR FROM t.d) AS y, 'a,b' AS z FROM c t, dw.y u WHERE (t.a = 1 OR t.b = 2) AND t.d BETWEEN '2024-01-01' AND '2024-02-01' GROUP BY 1 HAVING count(*) > 1 ORDER BY y LIMIT 5")
    assert s.ctes == ["c"] and {n for n, _ in s.tables} == {"x", "dw.y"} and s.distinct and s.limit == "5"
    assert [a for _, a in s.output] == ["a", "y", "z"] and len(s.having) == 1 and len(s.conditions) == 2  # BETWEEN is one
    assert structure.structure(spark, "select a from t union all select a from u union select a from v").union_parts == 3
    with pytest.raises(catalyst.ParseError):
        structure.structure(spark, "selekt 1")


def test_logic(spark):
    a = "SELECT o.id FROM orders o LEFT JOIN items i ON o.id = i.oid"
    b = "select o.id  from orders o INNER JOIN items i on o.id = i.oid -- same else"
    risks = [(r["level"], r["rule"]) for r in logic.risks(spark, a, b).collect()]
    assert risks == [("high", "join_type")]
    assert logic.identical(spark, a, a.lower().replace("select", "SELECT  ")) and not logic.identical(spark, a, b)
    assert not logic.identical(spark, "select 'a  b' as x", "select 'a b' as x")
    assert logic.risk_list(structure.structure(spark, "select 1 as x from a join b on a.k = b.k"), structure.structure(spark, "select 1 as x from a inner join b on a.k = b.k")) == []
    rules = [r["rule"] for r in logic.risks(spark, "select sum(x) as s from a join b on a.k = b.k", "select sum(x) as s from a join b on a.k = b.k2 group by k").collect()]
    assert rules == ["join_condition", "aggregate_without_group", "group_by"]
    fields = [r for r in logic.risks(spark, "select a, b as x from t", "select a, b as y from t").collect()]
    assert [(r["rule"], r[4], r[5]) for r in fields] == [("fields", "x", "y")]
    assert {r["kind"] for r in logic.text_diff(spark, a, b).collect()} >= {"hunk", "add", "del"}


def test_layers(spark):
    got = {r["table"]: r["layer"] for r in logic.layers(spark, "select * from dwd.x join dwd_v2.y on 1 = 1 join ods_z on 1 = 1 join other.q on 1 = 1").collect()}
    assert got == {"dwd.x": "dwd", "dwd_v2.y": "dwd", "ods_z": "ods", "other.q": "unknown"}


@pytest.mark.parametrize(
    "sql, level",
    [("select ';drop' as x limit 1", "safe"), ("select 1; select 2", "blocked"), ("", "blocked"), ("select a from t --comment", "warning"), ("select * from t limit 5", "warning"), ("/*M! drop */ select 1 limit 1", "blocked"), ("insert into t select 1", "blocked"), ("explain select 1", "safe"), ("select a from {{t}} limit 1", "blocked"), ("# select 1", "blocked"), ("select 1;", "warning"), ("select 1;;", "blocked"), ("select a from t limit 10001", "warning"), ("with x as (select 1 as a) select a from x limit 3", "safe"), ("select `set` from t limit 1", "blocked"), ("desc t", "safe"), ("select \"drop\" as x limit 1", "safe")],
)
def test_guard(sql, level):
    assert guard.level(sql) == level


def test_guarded_query(spark):
    spark.range(7).createOrReplaceTempView("seven")
    df, more = guard.query(spark, "select id from seven", 7)
    assert df.count() == 7 and not more
    assert guard.query(spark, "select id from seven", 6)[1]
    with pytest.raises(guard.NotReadOnly):
        guard.query(spark, "drop table seven")
    assert guard.query(spark, "(select id from seven limit 2)")[0].count() == 2  # by its plan a query
    told = {s: guard.findings(s, spark) for s in ("analyze table seven compute statistics", "show tables", "refresh table seven", "cache table seven")}
    assert {s for s, found in told.items() if ("blocked", "not_a_query") in found} == set(told) - {"show tables"}


def test_bounds_and_ranges(spark):
    assert rewrite.bounds("2026-08-17", "2026-08-17") == ("2026-08-17 00:00:00", "2026-08-17 23:59:59.999999")
    assert rewrite.bounds("2026-08-17 12:34", "2026-08-17 12:34") == ("2026-08-17 12:34:00", "2026-08-17 12:34:59.999999")
    assert rewrite.bounds("2026-08-17 12:34:56", "2026-08-17 12:34:56")[1] == "2026-08-17 12:34:56.999999"
    assert rewrite.date_range("where d >= '2024-03-01' and d < '2024-02-01 00:00' and e < '9999-12-31'", "2026-05-09") == ("2024-02-01", "2024-03-01")
    assert rewrite.date_range("select 1", "2026-05-09") == ("2026-05-01", "2026-05-09")
    days = spark.createDataFrame([("20240105",), ("2024-01-06",), ("20240109",)], "d string")
    assert days.where(rewrite.range_condition("d", "2024-01-05", "2024-01-06", day_text=True)).count() == 2


def test_time_filter_binds_as_and_in_every_branch(spark):
    spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id as int)) as ts, id % 2 as p, id as v from range(20)").createOrReplaceTempView("ev")
    df, mode = rewrite.filter_where_seen(spark, "select v from ev where p = 0 or p = 1 union all select v from ev", "ts", "2024-01-03", "2024-01-04")
    assert mode == "pushed_down" and sorted(r[0] for r in df.collect()) == [2, 2, 3, 3]
    df, mode = rewrite.filter_where_seen(spark, "with e as (select ts as t2, v from ev) select count(*) as n from (select ts, v from ev) x", "x.ts", "2024-01-03", "2024-01-04")
    assert mode == "pushed_down" and df.first()[0] == 2
    assert rewrite.detail(spark, "with e as (select * from ev where p = 1) select distinct p, count(*) as n from e where v > 4 group by p order by n limit 1").count() == 8
    assert rewrite.count(spark, "select p from ev group by p").first()[0] == 2


def test_ranges_give_way_and_the_session_stays(spark):
    spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id as int)) as ts, id % 2 as p, id as v from range(20)").createOrReplaceTempView("ev")
    cases = [  # query, mode, rows within 2024-01-03 to 2024-01-06
        ("select v from ev where ts between '2024-01-10' and '2024-01-11' and p = 0", "replaced", [2, 4]),
        ("select v from ev where date(ts) = '2024-01-10'", "replaced", [2, 3, 4, 5]),
        ("select v from ev where hour(ts) = 0 and ts is not null", "pushed_down", [2, 3, 4, 5]),
        ("select v from ev where ts > '2024-01-10' or p = 0", "pushed_down+range_left", [2, 4]),
        ("with ev as (select * from ev where ts = '2024-01-10' and v < 5) select v from ev", "replaced", [2, 3, 4]),
        ("with a as (select ts, v from ev), b as (select v from a where v > 2) select b.v from b union all select v from a", "pushed_down", [2, 3, 3, 4, 4, 5, 5]),
        ("select v from (with ev as (select * from ev where ts >= '2025-01-01') select ts, v from ev) x", "replaced", [2, 3, 4, 5]),
        ("select e.v from ev e join ev f on e.v = f.v where e.ts >= '2024-01-04' and f.ts >= '2024-01-05'", "replaced", [4, 5]),
    ]
    for sql, mode, want in cases:
        df, how = rewrite.filter_where_seen(spark, sql, "e.ts" if "e.ts" in sql else "ts", "2024-01-03", "2024-01-06")
        assert (how, sorted(r[0] for r in df.collect())) == (mode, want), sql
    assert rewrite.detail(spark, "with ev as (select * from ev where v < 3) select p, count(*) from ev group by p").count() == 3
    assert spark.table("ev").count() == 20


def test_packing():
    assert slicing.pack([(1, 3), (2, 3), (3, 0), (4, 9), (5, 1), (6, 4)], 5) == [(1, 1, 3, False), (2, 2, 3, False), (4, 4, 9, True), (5, 6, 5, False)]
    assert slicing.pack([], 5) == []


def test_slices_are_refined_and_account_for_all(spark):
    q = "select timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, cast(id * 600 as int)) as ts from range(500) union all select timestamp_ntz'2024-01-02 05:00:00' from range(90) union all select null"
    df = spark.sql(q)
    s = slicing.plan(df, "ts", 60)
    rows = s.orderBy("slice").collect()
    assert {r["grain"] for r in rows} == {"hour", "minute"} and [r["over"] for r in rows].count(True) == 1
    for a, b in zip(rows, rows[1:]):
        assert a["end"] < b["start"]
    got = slicing.audit(df, "ts", s).first()
    assert got["total"] == 591 and got["planned"] == got["fetched"] == 590 and not got["complete"] and "slices_over" in got["issues"]
    good = slicing.audit(df.where("ts < timestamp_ntz'2024-01-01 12:00:00'"), "ts", slicing.plan(df.where("ts < timestamp_ntz'2024-01-01 12:00:00'"), "ts", 60)).first()
    assert good["complete"]
    assert slicing.audit(df.limit(0), "ts", slicing.plan(df.limit(0), "ts", 60)).first()["total"] == 0


def test_names(spark):
    assert naming.parse_pairs("a => b\n c -> d \ne,f\ng\th\nalone\n") == {"a": "b", "c": "d", "e": "f", "g": "h"}
    with pytest.raises(ValueError):
        naming.Rule("affix")
    with pytest.raises(ValueError):
        naming.Rule("other")
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    got = [r[0] for r in names.select(naming.mapped(names["name"], naming.Rule("pairs", pairs={"a": "X"}))).collect()]
    assert got == ["X", "b"]
    assert naming.java_replacement(r"\1_$\g<n>") == r"$1_\$${n}"
    store = spark.createDataFrame([], naming.STORE_SCHEMA)
    store = naming.save_pairs(store, "g", spark.createDataFrame([("a", "b"), ("c", None)], "a string, b string"), "now")
    assert naming.pairs_of(store, "g", "B")[1] == 1 and naming.pairs_of(store, "g", "zz")[1] == 0
    assert naming.saved_for(store, "none", "g", "").count() == 1
    assert naming.save_pairs(store, "g", store.limit(0).select("a", "b"), "now").count() == 0


def test_catalogs(spark):
    spark.sql("create database if not exists d1")
    spark.sql("create database if not exists d2")
    for db, n in (("d1", 3), ("d2", 4)):
        spark.range(n).write.mode("overwrite").saveAsTable(f"{db}.t")
    spark.range(1).write.mode("overwrite").saveAsTable("d1.only")
    try:
        got = {(r["a"], r["b"], r["status"]) for r in api.catalog_compare(spark, "d1", "d2").collect()}
        assert got == {("t", "t", catalog.OTHER_ROWS), ("only", "only", catalog.ONLY_A)}
        with pytest.raises(ValueError):
            api.catalog_compare(spark, "d1", "d1")
        out = api.table_diff(spark.table("d1.t"), spark.table("d2.t"), ["id"], limit=2)
        assert out["rows"] == (3, 4) and out["sampled"] and out["sample"].verdict.first()["level"] == "warn"
    finally:
        spark.sql("drop database d1 cascade")
        spark.sql("drop database d2 cascade")


def test_schema_text(spark):
    cols = spark.createDataFrame([("t", "b", "int", 2, False), ("t", "a", "bigint", 1, True), ("s", "x", "string", 1, False)], "table string, name string, type string, pos int, is_key boolean")
    assert tuple(catalog.schema_text(cols).first()) == ("table s (x string)\ntable t (a bigint PRIMARY KEY, b int)", 2)
    assert tuple(catalog.schema_text(cols, 1).first()) == ("table s (x string)\n... and 1 more tables", 2)


def test_result_diff_by_bare_and_aliased_keys(spark):
    a = spark.createDataFrame([(1, "x")], "`t.id` int, v string")
    b = spark.createDataFrame([("1", "y")], "ID string, v string")
    got = api.result_diff(a, b, ["t.id"])
    assert got.stats.first()["diff_cells"] == 1 and got.verdict.first()["level"] == "diff"
    twice = spark.createDataFrame([(1, 2, 3)], "id int, v int, w int").toDF("id", "x.v", "y.v")
    got = api.result_diff(twice, twice, ["id"])
    assert got.notes["ambiguous"] == ["v"] and got.verdict.first()["cause"] == "structure"


def test_query_diff(spark):
    spark.sql("select cast(id as int) as id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id as int)) as ts, id % 3 as v from range(10)").createOrReplaceTempView("qa")
    got = api.query_diff(spark, "select id, ts, v from qa", "select id, ts, case when id = 4 then 9 else v end as v from qa", ["id"], "ts", "2024-01-02", "2024-01-08")
    s = got.stats.first()
    assert (s["rows_a"], s["diff_cells"]) == (7, 1)
    ready = api.sql_prepare(spark, "select id, ts as order_time from qa where order_time > '2024-01-02'", "2024-03-01")
    assert ready["range"] == ("2024-01-02", "2024-01-02") and ready["time_columns"].first()["column"] == "order_time"
    assert api.detail(spark, "select id, ts from qa", ["id"], "ts", "2024-01-02", "2024-01-04", 2).count() == 2


def test_ranges_give_way_in_every_block(spark):
    spark.sql("select id, id % 5 as v, timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, int(id)) as ts from range(96)").createOrReplaceTempView("hours")
    cases = [
        ("SELECT count(*) FROM (SELECT id, ts FROM hours WHERE ts < '2024-01-01 03:00') q WHERE ts < '2024-01-01 02:00'", "ts", 72),
        ("SELECT count(*) FROM hours a JOIN hours b ON a.id = b.id AND a.ts < '2024-01-02'", "a.ts", 72),
        ("SELECT count(*) FROM hours WHERE date_format(ts, 'yyyy-MM-dd') = '2024-01-01' AND id >= 0", "ts", 72),
        ("SELECT sum(n) FROM (SELECT date(ts) AS d, count(*) AS n FROM hours GROUP BY date(ts)) x WHERE x.d = '2024-01-01'", "ts", 72),
        ("SELECT sum(n) FROM (SELECT date_format(ts, 'yyyy-MM-dd') AS d, count(*) AS n FROM hours GROUP BY 1 HAVING d < '2024-01-02') WHERE d LIKE '2024-01-01%'", "ts", 72),
        ("WITH w AS (SELECT ts AS t2, id FROM hours WHERE ts < '2024-01-01 05:00') SELECT count(*) FROM w WHERE t2 >= '2024-01-01 04:00'", "ts", 72),
        ("SELECT count(*) FROM hours a JOIN hours b USING (id) WHERE a.ts < '2024-01-02' AND b.ts >= '2024-01-02'", "a.ts", 48),
        ("SELECT count(*) FROM (SELECT t2 FROM (SELECT *, ts AS t2 FROM hours) WHERE substr(t2, 1, 10) = '2024-01-02') WHERE year(t2) = 2024 AND t2 IN ('2024-01-01')", "ts", 72),
    ]
    for sql, column, want in cases:
        df, mode = rewrite.filter_where_seen(spark, sql, column, "2024-01-01", "2024-01-03")
        assert (mode, df.first()[0]) == ("replaced", want), sql
    df, mode = rewrite.filter_where_seen(spark, "SELECT count(*) FROM hours WHERE NOT ts < '2024-01-02' AND id > 0", "ts", "2024-01-01", "2024-01-03")
    assert (mode, df.first()[0]) == ("pushed_down+range_left", 48)
    with pytest.raises(scopes.Ambiguous, match="a.ts or b.ts"):
        rewrite.filter_where_seen(spark, "SELECT count(*) FROM hours a JOIN hours b ON a.id = b.id", "ts", "2024-01-01", "2024-01-03")


def test_time_columns_know_their_block(spark):
    scope = lambda sql: {r["column"]: r["scope"] for r in structure.time_columns(spark, sql).collect()}
    one = scope("SELECT k, n FROM (SELECT k, count(*) AS n FROM (SELECT k, ts AS event_time, load_date FROM none.t WHERE load_date > '2024') a GROUP BY k, event_time) b")
    assert one == {"event_time": "pushdown", "load_date": "pushdown"}
    two = scope("WITH c AS (SELECT k, pay_date FROM none.t WHERE ship_date > '2024') SELECT k FROM c WHERE pay_date > '2024'")
    assert two == {"pay_date": "top", "ship_date": "pushdown"}


def test_same_meaning_is_no_risk(spark):
    f = "SELECT t.a FROM x.t t LEFT JOIN x.u u ON {on} WHERE {where}"
    base = dict(on="t.i = u.i", where="t.a = 1")
    same = [
        dict(where="1 = t.a"), dict(on="u.i = t.i"), dict(where="t.a IN (1)"), dict(where="t.a = 1.0"), dict(where="NOT (t.a <> 1)"), dict(where="t.a >= 1 AND t.a <= 1"), dict(where="(t.a = 1) AND t.a < 5"),
    ]
    risk = lambda x, y: [r["rule"] for r in logic.risks(spark, x, y).collect()]
    for change in same:
        assert risk(f.format(**base), f.format(**base | change)) == [], change
    other = [dict(where="t.a = 2"), dict(where="t.a <= 1"), dict(where="u.a = 1"), dict(where="t.a = 1 OR t.b = 2"), dict(where="t.a = '1'"), dict(where="NOT t.a = 1")]
    for change in other:
        assert risk(f.format(**base), f.format(**base | change)) == ["conditions"], change
    assert risk(f.format(**base), f.format(**base | dict(on="t.i = u.j"))) == ["join_condition"]
    assert risk("SELECT x.a FROM t x WHERE x.a BETWEEN 1 AND 5 GROUP BY x.a, x.b", "SELECT y.a FROM t y WHERE y.a >= 1 AND 5 >= y.a GROUP BY y.b, y.a") == []
    assert risk("SELECT a FROM t WHERE a > 3 AND a > 1", "SELECT a FROM t WHERE t.a > 3") == []
    assert risk("SELECT a FROM t WHERE a > 3 AND a > 1", "SELECT a FROM t WHERE a > 1") == ["conditions"]
    assert risk("SELECT x.a FROM t x JOIN t y ON x.i = y.p WHERE x.a = 1", "SELECT q.a FROM t q JOIN t r ON r.p = q.i WHERE q.a = 1") == []
    assert risk("SELECT x.a FROM t x JOIN t y ON x.i = y.p WHERE x.a = 1", "SELECT x.a FROM t x JOIN t y ON x.i = y.p WHERE y.a = 1") == ["conditions"]
