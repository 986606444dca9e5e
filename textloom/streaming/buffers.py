"""Bounded logs: the newest records of each kind, kept between flushes of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metadata import keep_last
from ..session import delete_folder

#: How many records of each kind a buffer holds.
LIMITS = {"console": 500, "network": 200, "ui": 500}


def merged(old: DataFrame, new: DataFrame, limit: int) -> DataFrame:
    """The newest records of each kind of an older buffer and a flush together."""
    return keep_last(old.unionByName(new), "kind", "seq", limit)


def ring_buffers(stream: DataFrame, path: str, checkpoint: str, limit: int = 500, every: str = "2 seconds", once: bool = False) -> StreamingQuery:
    """Keep the newest `limit` records (kind, seq, ...) of each kind under `path`.

    Each flush is written beside the last one under its number, so that a flush that fails is repeated as a whole; those before
    the last one are deleted then, so that two are kept at most.
    """

    def flush(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = batch
        if number > 0:
            now = spark.read.schema(batch.schema).parquet(f"{path}/flush={number - 1}").unionByName(batch)
        keep_last(now, "kind", "seq", limit).write.mode("overwrite").parquet(f"{path}/flush={number}")
        # The last one stays: this flush reads it again if its commit is lost.
        if number > 1:
            delete_folder(spark, f"{path}/flush={number - 2}")

    writer = stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def errors_of(requests: DataFrame) -> DataFrame:
    """Error events of captured requests: those that answered 400 or more."""
    return requests.where(F.col("status") >= 400).select("seq", F.lit("network_error").alias("kind"), "url", "status")
