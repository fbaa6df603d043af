"""The ledger as a store in buckets, of which a round rewrites only those that it touches.

Entries lie by hash of pk in as many folders as the ledger has buckets. A round reads the buckets of its differences and of its
scope, writes them anew below a folder of its own, and then writes a manifest that says where each
bucket is; the manifest's appearance is what makes the round count. A reader takes the newest manifest,
so it sees a round whole or not at all, and a round that fails leaves files that nobody reads. A round is
known by its number: one that was done before changes nothing. Old rounds' files stay until `vacuum`.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.operators import ledger

BUCKETS = 1024


def bucket(pk: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(pk) if isinstance(pk, str) else pk, F.lit(""))), F.lit(buckets)).cast("int")


class Store:
    """A ledger below a path of any file system that Spark reads. buckets counts for a new one; a ledger
    keeps the number that it has."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.jvm = spark._jvm
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def rounds(self) -> list[int]:
        """Numbers of the rounds that count."""
        if not self.fs.exists(self._at("manifests")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._at("manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int | None = None) -> dict[int, str]:
        """Folder of each bucket that has entries, after a round (the newest)."""
        known = [r for r in self.rounds() if number is None or r <= number]
        if not known:
            return {}
        text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/{known[-1]}.json", wholetext=True).collect())
        held = json.loads(text)
        self.buckets = held["buckets"]
        return {int(k): v for k, v in held["folders"].items()}

    def _swap(self, number: int, new: dict[int, str]) -> None:
        """Writes a manifest under another name and renames it, so it is there whole or not at all."""
        out = self.fs.create(self._at(f"manifests/{number}.json.part"), True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "folders": new}).encode()))
        out.close()
        if not self.fs.rename(self._at(f"manifests/{number}.json.part"), self._at(f"manifests/{number}.json")):
            raise RuntimeError(f"round {number} was written by another writer")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], ledger.SCHEMA)
        return self.spark.read.schema(ledger.SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])

    def entries(self, number: int | None = None) -> DataFrame:
        """All entries, after a round (the newest)."""
        return self._read(sorted(self.manifest(number).values()))

    def merge(self, number: int, diffs: DataFrame, scope: DataFrame, label: str) -> int:
        """Merges a round (see ledger.merge) unless it was done before; returns how many buckets it wrote."""
        if number in self.rounds():
            return 0
        now = self.manifest(number)
        touched = sorted(r[0] for r in diffs.select("pk").union(scope.select("pk")).select(bucket("pk", self.buckets)).distinct().collect())  # at most as many as there are buckets
        before = self._read([now[b] for b in touched if b in now])
        after = ledger.merge(before, diffs, scope, label).withColumn("bucket", bucket("pk", self.buckets))
        after.repartition(max(1, min(len(touched), 64)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/round={number}")
        wrote = {b: f"round={number}/bucket={b}" for b in touched if self.fs.exists(self._at(f"round={number}/bucket={b}"))}
        self._swap(number, now | wrote)
        return len(wrote)

    def vacuum(self) -> int:
        """Deletes folders that the newest manifest doesn't name, and older manifests; returns how many
        folders went. No reader of an older round may be at work."""
        known = self.rounds()
        used, gone = set(self.manifest().values()), 0
        for r in self.fs.listStatus(self._at("")):
            if not r.getPath().getName().startswith("round="):
                continue
            for b in self.fs.listStatus(r.getPath()):
                name = f"{r.getPath().getName()}/{b.getPath().getName()}"
                if b.getPath().getName().startswith("bucket=") and name not in used:
                    self.fs.delete(b.getPath(), True)
                    gone += 1
        for old in known[:-1]:
            self.fs.delete(self._at(f"manifests/{old}.json"), False)
        return gone
