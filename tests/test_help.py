"""Connections, hints, documents."""

import zipfile
from xml.etree import ElementTree

import pytest

from reckon.plans import hints
from reckon.sinks.document import write_document
from reckon.sources import jdbc


def test_connections():
    c = jdbc.Connection("jdbc:mysql://{cluster}:9030/{db}", user="u", password="secret", clusters=jdbc.parse_profiles("# x\nmain = host1\ntest | host2\nmain = other"), timeout=1)
    assert c.on("", "d") == "jdbc:mysql://host1:9030/d" and c.on("test", "d").startswith("jdbc:mysql://host2") and c.timeout == 5
    assert "secret" not in repr(c) and c.without_secrets().password == ""
    for url in ("mysql://x", "jdbc:x\n", "jdbc:mysql://u:p@h/d", "jdbc:mysql://h/d?password=x", "jdbc:mysql://h/d?useSSL=false", "jdbc:hive2://h;pwd=x"):
        with pytest.raises(jdbc.ConnectionRefused):
            jdbc.Connection(url)
    with pytest.raises(jdbc.ConnectionRefused):
        jdbc.Connection("jdbc:mysql://{host}/d").on()
    with pytest.raises(jdbc.ConnectionRefused):
        c.on("none")
    assert jdbc.Connection("jdbc:mysql://h/d?useSSL=false", allow_insecure=True)


def test_hints(spark):
    assert "GROUP BY" in hints.explain_error("[MISSING_AGGREGATION] x") and hints.explain_error("other") == "other"
    assert hints.is_day_grain(spark, "select t.d from (select date_format(ts, 'yyyyMMdd') as d from x) t", "d")
    assert not hints.is_day_grain(spark, "select ts as d from x", "d")
    ids = [r["id"] for r in hints.probe_texts(spark, "select a.id from a left join b on a.id = b.aid join c on c.k = b.k", ["id"]).collect()]
    assert ids == ["P0", "P1", "P2", "J1", "M1", "J2", "M2"]
    assert hints.first_object('text ```json\n{"a": {"b": 1}} more {"c": 2}') == {"a": {"b": 1}} and hints.first_object("none") is None
    assert hints.asked(lambda p: '{"sql": "drop table t"}', "x") == {"sql": "", "blocked": ["not_a_query", "write_words"]}
    assert hints.asked(lambda p: '{"sql": "select a from t limit 1"}', "x")["sql"]


def test_documents(spark, tmp_path):
    df = spark.createDataFrame([tuple(range(14)), tuple(range(14))], ", ".join(f"c{i} long" for i in range(14)))
    assert write_document(str(tmp_path / "x.docx"), df, "title", most=1) == (1, 2)
    root = ElementTree.fromstring(zipfile.ZipFile(tmp_path / "x.docx").read("word/document.xml"))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    tables = list(root.iter(f"{w}tbl"))
    heads = [[t.text for t in next(x.iter(f"{w}tr")).iter(f"{w}t")] for x in tables]
    assert heads == [[f"c{i}" for i in range(12)], ["c0", "c12", "c13"]]
