"""Every operator on columns with clashing names, nulls in any column, repeated rows and no rows."""

import pytest
from pyspark.sql import functions as F

from reckon.llm import bpe, decontam, fingerprint, lang_id, licenses, pii, quality, sharding, simhash

OPERATORS = {
    "lang_id": lang_id.identify,
    "bpe": bpe.encode_documents,
    "fingerprint": fingerprint.edited_and_next,
    "fingerprints": fingerprint.fingerprints,
    "quality": lambda d: quality.rate(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))),
    "licenses": licenses.scan,
    "simhash": simhash.near_duplicates,
    "sharding": sharding.shuffle_into_shards,
    "pii": pii.digest,
    "pii_mask": pii.mask,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(name, clashing, rows):
    out = OPERATORS[name](clashing)
    got = sorted(str(r["doc_id"]) for r in out.select("doc_id").collect())
    assert got == sorted(str(r[0]) for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_all_null(name, spark):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    assert OPERATORS[name](docs).count() == 3


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(name, empty):
    assert OPERATORS[name](empty).count() == 0


def test_decontamination_edges(clashing, docs, empty):
    bench = docs.where("doc_id = 7").select(F.col("doc_id").alias("item_id"), "text", F.lit(1).alias("doc_id"), F.lit(1).alias("start"))
    hit = {r["doc_id"] for r in decontam.hits(clashing, bench).collect()}
    assert 7 in hit
    kept = decontam.drop_contaminated(clashing, bench)
    assert kept.columns == clashing.columns and not {r["doc_id"] for r in kept.collect()} & (hit - {None})
    assert decontam.hits(empty, bench).count() == 0 and decontam.drop_contaminated(empty, bench).count() == 0
