"""Tables kept between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_given: dict[str, list[str]] = {}


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh path below spark.checkpoint.dir; where that is unset and all runs in one process, below
    a temporary folder. On a cluster such a folder would be each machine's own, so it is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="reckon-"))
    path = f"{base.rstrip('/')}/reckon/{purpose}-{uuid.uuid4().hex}"
    _given.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def keep(df: DataFrame, purpose: str) -> DataFrame:
    """df written once and read back: one computation for all who read it, and a short lineage."""
    path = scratch(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes all that this application has kept or written below paths from scratch (tables, archives,
    blocks, workbooks); returns how many paths. DataFrames that read them are of no use afterwards."""
    paths = _given.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
