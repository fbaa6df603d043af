"""Files: delimited, pasted text, workbooks, literals, typed cells, blocks, reports."""

import io
import zipfile

import pytest

from reckon import api, queries
from reckon.functions import export, literals
from reckon.operators.keyed_diff import KeyedDiff
from reckon.sinks import report, workbook
from reckon.sources import blocks, delimited
from reckon.sources import workbook as reader


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿编号,备注,值\r\n1,\"a, \"\"b\"\"\nc\",NULL\r\n2,,\r\n".encode())
    df = delimited.read_table(spark, f"file://{tmp_path}/a.csv")
    assert df.columns == ["编号", "备注", "值"]
    assert sorted(tuple(r) for r in df.collect()) == [("1", 'a, "b"\nc', "NULL"), ("2", "", "")]
    (tmp_path / "b.txt").write_bytes("id\tname\n1\t张三\n".encode("gbk"))
    assert delimited.read_table(spark, f"file://{tmp_path}/b.txt").collect()[0]["name"] == "张三"
    with pytest.raises(delimited.ReadError):
        delimited.read_table(spark, "x.xls")


def test_pasted_text():
    assert delimited.text_rows("\n\na,b\n\n1,\"x,y\"\n\n") == [["a", "b"], ["", ""], ["1", "x,y"]]
    assert delimited.text_rows("a  b c   d\n1  2 3  4") == [["a", "b c", "d"], ["1", "2 3", "4"]]
    assert delimited.text_rows("a|b\n1") == [["a", "b"], ["1", ""]]
    assert delimited.text_rows("") == []


def test_workbook_round_trip(spark, tmp_path):
    cols = ("编号", "日期", "金额", "比例", "备注", "命令", "超大值")
    df = spark.createDataFrame([("001", "2024-01-05", "1234.50", "12.5%", "text", "=1+1", "1234567890123456789"), (None, "2024-01-05 10:20:30", "5", "", "", "plain", "7")], ", ".join(f"`{c}` string" for c in cols))
    told = workbook.write_workbook(str(tmp_path / "x.xlsx"), {"数据": df, "two": df.limit(0)}, most=1)
    assert told == {"数据": (1, 2), "two": (0, 0)}
    cut = {s.name: reader.table_of(s)[1] for s in reader.sheets((tmp_path / "x.xlsx").read_bytes())}
    assert [r for _, r in cut[workbook.CUT]] == [["数据", "1", "2", "1/2"]]
    workbook.write_workbook(str(tmp_path / "x.xlsx"), {"two": df.limit(0), "数据": df})
    back, meta = reader.read_sheet(spark, f"file://{tmp_path}/x.xlsx")
    assert meta["sheet"] == "数据" and back.columns == ["_row", *cols]
    rows = {r["_row"]: r for r in back.collect()}
    assert rows[2]["编号"] == "001" and rows[2]["日期"] == "2024-01-05" and rows[2]["命令"] == "'=1+1" and rows[2]["超大值"] == "1234567890123456789"
    assert float(rows[2]["金额"]) == 1234.5 and float(rows[2]["比例"]) == 0.125 and rows[3]["日期"] == "2024-01-05 10:20:30"
    assert [r["name"] for r in reader.list_sheets(spark, f"file://{tmp_path}/x.xlsx").collect()] == ["two", "数据"]
    a, b, guess = api.open_pair(spark, f"file://{tmp_path}/x.xlsx", f"file://{tmp_path}/x.xlsx")
    assert guess.count() == 4 and api.file_diff(a, b, ["备注"]).stats.first()["diff_cells"] == 0


def test_formulas_and_titles():
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = f'<worksheet xmlns="{main}"><dimension ref="A1"/><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>id</t></is></c><c r="B3" t="inlineStr"><is><t>sum</t></is></c></row><row r="4"><c r="A4"><v>1</v></c><c r="B4"><f>A4+1</f></c></row></sheetData></worksheet>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    own = reader.sheets(data.getvalue())[0]
    headers, rows = reader.table_of(own)
    assert headers == ["id", "sum"] and rows == [(4, ["1", "=A4+1"])] and own.formulas == 1


def test_text_without_readings():
    item = reader.ElementTree.fromstring('<si xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><r><t>東</t></r><r><t>京</t></r><rPh sb="0" eb="2"><t>トウキョウ</t></rPh></si>')
    assert reader._text_of(item) == "東京"


def test_csv_is_escaped(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", " +cmd", None), ("plain", "-5", "\tx")], "`=h` string, b string, c string")
    workbook.write_csv(df, f"file://{tmp_path}/out")
    text = "".join(p.read_bytes().decode("utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert text.startswith("﻿") and "'=h" in text and "'=1+1" in text and "' +cmd" in text and "'-5" in text


def test_ddl_and_literals(spark):
    table, cols = literals.parse_ddl("CREATE TABLE IF NOT EXISTS `db`.`t` (`金额（元）` decimal(18,2) COMMENT 'a,b', 业务日期 date, n bigint NOT NULL, big DECIMAL(38,18), small decimal(5,2), s varchar(20) DEFAULT 'x', PRIMARY KEY (n), KEY k (s)) ENGINE=x")
    by = {c.name: c for c in cols}
    assert table == "db.t" and list(by) == ["金额（元）", "业务日期", "n", "big", "small", "s"]
    assert (by["金额（元）"].precision, by["金额（元）"].scale) == (18, 2) and by["s"].quoted and not by["n"].nullable
    cases = [
        ("s", "NULL", "'NULL'", None), ("n", "NULL", "NULL", None), ("s", "\\N", "NULL", None), ("s", "a'b\\", "'a\\'b\\\\'", None), ("n", "1,234", "1234", None), ("n", "x", None, "not_a_number"),
        ("small", "999.995", None, "out_of_range"), ("small", "12.345", "12.34", None), ("small", "-1.5", "-1.50", None), ("n", "100.0", "100", None), ("n", "", "NULL", None), ("n", "NaN", None, "not_a_number"), ("业务日期", "2024-01-05", "'2024-01-05'", None),
    ]
    for column, value, sql, error in cases:
        df = spark.createDataFrame([(value,)], "v string")
        got = df.select(literals.literal(df["v"], by[column]).alias("x")).select("x.*").first()
        assert tuple(got) == (sql, error), (column, value)
    with pytest.raises(ValueError):
        literals.match_columns(["a", "A"], cols)
    number = by["n"]
    table, cols = literals.parse_ddl("""create table "s"."t" (`a` varchar(20) COMMENT 'x) y', "a b" int not null, key varchar(9), `index` int, KEY k (b), DUPLICATE KEY(k1), AGGREGATE KEY (k1), UNIQUE KEY u (a),
      PRIMARY KEY (a), CONSTRAINT c CHECK (b > 0), tags array<int> DEFAULT 'a,(b', n numeric(5))""")
    assert table == "s.t" and [(c.name, c.nullable) for c in cols] == [("a", True), ("a b", False), ("key", True), ("index", True), ("tags", True), ("n", True)]
    assert (cols[-1].precision, cols[-1].scale) == (5, 0) and literals.unmatched(["A", "z"], cols) == {"headers": ["z"], "columns": ["a b", "key", "index", "tags", "n"]}
    for bad in ("create table t", "select 1", "create table t (primary key (a))"):
        with pytest.raises(ValueError):
            literals.parse_ddl(bad)
    assert literals.quoted_table("sales.order") == "`sales`.`order`"
    floats = spark.createDataFrame([(1.2345678901234568e18,), (12.5,), (float("nan"),)], "v double")
    assert [r[0]["error"] for r in floats.select(literals.literal(floats["v"], number, True)).collect()] == ["not_exact", None, "not_a_number"]


def test_inserts(spark):
    cols = literals.parse_ddl("create table t (id int, name varchar(9))")[1]
    df = spark.createDataFrame([(f"{i}", f"n{i}" if i % 2 else None) for i in range(7)] + [("", " ")], "ID string, NAME string")
    got = literals.inserts(df, "t", cols, ["ID"], 3).orderBy("batch").collect()
    assert [r["sql"].count("\n(") for r in got] == [3, 3, 1] and got[0]["sql"].startswith("INSERT INTO `t` (`id`, `name`) VALUES\n(0, NULL),\n(1, 'n1')")
    with pytest.raises(Exception, match="not_a_number"):
        literals.inserts(spark.createDataFrame([("x", "y")], "id string, name string"), "t", cols, ["id"]).collect()


def test_bands():
    cols = [f"c{i}" for i in range(14)]
    got = export.bands(cols, 8)
    assert got == [cols[:8], ["c0", *cols[8:]]] and export.bands(cols, 20) == [cols]


def test_display(spark):
    df = spark.createDataFrame([(0.125, 1234.5, 6172.799999999999, 3.0, 5)], "a double, b double, c double, d double, e long")
    got = df.select(export.display(df["a"], "double", "占比"), export.display(df["b"], "double", "金额"), export.display(df["c"], "double"), export.display(df["d"], "double"), export.display(df["e"], "long")).first()
    assert tuple(got) == ("12.50%", "1,234.50", "6172.8", "3", "5")


def test_blocks(spark):
    b = [{"text": "交 易 日 期", "x": 0.1, "y": 0.1, "w": 0.1, "h": 0.02}, {"text": "a b", "x": 0.5, "y": 0.101, "w": 0.1, "h": 0.02}, {"text": "1", "x": 0.11, "y": 0.2, "w": 0.1, "h": 0.02}]
    schema = "image string, text string, x double, y double, w double, h double"
    got = blocks.tables(spark.createDataFrame([("i", x["text"], x["x"], x["y"], x["w"], x["h"]) for x in b], schema))
    assert [(r["row"], r["cells"]) for r in got.orderBy("row").collect()] == [(1, ["交易日期", "a b"]), (2, ["1", ""])]
    assert blocks.tables(spark.createDataFrame([], schema)).collect() == []
    # slanted rows, two blocks in a cell, a null text, a column that is filled too seldom, no place
    rows = [("j", f"r{r}", 0.1 + 0.001 * r, 0.05 * r, 0.1, 0.02) for r in range(20)] + [("j", "x", 0.13, 0.0, 0.1, 0.02), ("j", "y", 0.5, 0.0, 0.1, 0.02), ("j", None, 0.9, 0.3, 0.1, 0.02), ("j", "?", None, 0.3, 0.1, 0.02)]
    got = blocks.tables(spark.createDataFrame(rows, schema), column_gap=0.04).orderBy("row").collect()
    assert [r["cells"] for r in got] == [["r0 x"]] + [[f"r{r}"] for r in range(1, 20)]
    df = spark.createDataFrame([("i", "a", 0.1, 0.1, 0.2), ("i", "b", 0.2, 0.2, 0.9)], "image string, text string, x double, y double, conf double")
    r = blocks.quality(df).first()
    assert (r["blocks"], r["mean_conf"], r["low"]) == (2, 0.55, ["a"])


def test_reports(spark, tmp_path):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, v string")
    b = spark.createDataFrame([("1", "z"), ("3", "y")], "id string, v string")
    told = report.file_report(KeyedDiff(a, b, ["id"]), str(tmp_path / "r.xlsx"))
    assert told[report.CELLS] == (1, 1) and told[report.ONLY_A] == (1, 1)
    names = [s.name for s in reader.sheets((tmp_path / "r.xlsx").read_bytes())]
    assert names == [report.SUMMARY, report.CELLS, report.ONLY_A, report.ONLY_B]
    assert report.sql_report(KeyedDiff(a, b, ["id"]), str(tmp_path / "s.xlsx"))[report.LOG][1] == 3


def test_paths(tmp_path):
    (tmp_path / "a.csv").write_text("x")
    (tmp_path / "b.exe").write_text("x")
    assert [n for n, *_ in workbook.artifacts(str(tmp_path))] == ["a.csv"]
    assert workbook.within(str(tmp_path), "a.csv").name == "a.csv"
    with pytest.raises(ValueError):
        workbook.within(str(tmp_path), "../x")
    assert workbook.safe_name("a/b c?.xlsx") == "a_b_c_.xlsx"


def test_workbook_of_all_orders(spark, tmp_path):
    """No order is lost, whatever its key, and full sheets go on in further ones."""
    df = spark.sql("SELECT id AS o_orderkey, date_add(DATE'1995-01-01', CAST(id % 900 AS INT)) AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(190, 300)")
    df.write.parquet(f"{tmp_path}/orders.parquet")
    want = sorted((str(r[0]), f"{r[1]}", r[2]) for r in df.collect())
    assert sorted(map(tuple, queries.QUERIES["xlsx_round_trip_all"](spark, str(tmp_path)).collect())) == want
    spark.sql("SELECT id AS c_custkey, concat('Customer ', id) AS c_name, 'AUTO' AS c_mktsegment FROM range(60)").write.parquet(f"{tmp_path}/customer.parquet")
    assert sorted(int(r["id"]) for r in queries.QUERIES["xlsx_round_trip"](spark, str(tmp_path)).collect()) == list(range(60))
    told = workbook.write_workbook(str(tmp_path / "x.xlsx"), {"orders": df.orderBy("o_orderkey"), "none": df.limit(0)}, most=50, split=True)
    assert told == {"orders": (110, 110), "none": (0, 0)}
    found = reader.sheets((tmp_path / "x.xlsx").read_bytes())
    assert [(s.name, len(s.grid) - 1) for s in found] == [("orders", 50), ("orders (2)", 50), ("orders (3)", 10), ("none", 0)]
    assert [r[0] for s in found for _, r in reader.table_of(s)[1]] == [str(i) for i in range(190, 300)]


def test_workbooks_by_executors(spark, tmp_path):
    from reckon.sinks.workbook import write_workbooks
    from reckon.sources.workbook import read_workbooks

    df = spark.range(500).selectExpr("id as `order``id`", "concat('n', id % 7) as name", "if(id % 5 = 0, null, concat('=x', id)) as note")
    assert write_workbooks(df, f"file://{tmp_path}/books", ["order`id"], most=120) == 500
    files = sorted(p.name for p in (tmp_path / "books").iterdir() if p.suffix == ".xlsx")
    assert len(files) == 5
    back = read_workbooks(spark, f"file://{tmp_path}/books", ["order`id", "name", "note", "none"])
    want = sorted((str(i), f"n{i % 7}", None if i % 5 == 0 else f"'=x{i}", None) for i in range(500))
    assert sorted(tuple(r) for r in back.collect()) == want
    assert write_workbooks(df.limit(0), f"file://{tmp_path}/none", ["name"]) == 0


def test_indexes_named_like_types_are_no_columns():
    names = lambda ddl: [c.name for c in literals.parse_ddl(ddl)[1]]
    parts = "KEY date_idx (created), INDEX int_x (id), KEY text_key (id), CONSTRAINT set_fk FOREIGN KEY (id) REFERENCES u (id), EXCLUDE USING gist (c WITH &&), PERIOD FOR span (a, b), KEY date (created), INDEX `int` (id)"
    assert names(f"CREATE TABLE t (id int, created date, {parts})") == ["id", "created"]
    assert names("CREATE TABLE t (key varchar(20), index int NOT NULL, period date, partition decimal(5,2), `check` text)") == ["key", "index", "period", "partition", "check"]
