"""A ledger kept by a stream: each micro-batch of differences is a round.

The ledger is a store in buckets (operators/ledger_store.py), and a round's number is its batch's, so
a batch writes only the buckets that it touches, and one that runs again after a failure either finds
its round done or writes it whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reckon.operators.ledger_store import BUCKETS, Store


def current(spark: SparkSession, path: str) -> DataFrame:
    """The ledger below path, or an empty one."""
    return Store(spark, path).entries()


def start(diffs: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Merges the stream diffs (pk, col, a, b, kind, and round: a label) into the ledger at path.
    Rows with an empty col say only that their pk was looked at in the round."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        label = batch.agg(F.max("round")).first()[0]
        if label is None:
            return
        real = batch.where("col <> ''").select("pk", "col", "a", "b", "kind")
        Store(spark, path, buckets).merge(number, real, batch.select("pk"), label)

    return diffs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
