"""Continuous ingest: a stream's micro-batches are upserted, and compaction runs when it is due."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quiverlake.operators import dml
from quiverlake.sources.collection import Collection


def upsert_stream(stream: DataFrame, collection: Collection, checkpoint: str, compact_every: int = 10, **trigger) -> StreamingQuery:
    """Each micro-batch becomes one version; every compact_every-th also compacts. trigger: as for DataStreamWriter.trigger."""

    def write(batch: DataFrame, number: int) -> None:
        collection.upsert(batch)
        if number % compact_every == compact_every - 1:
            collection.optimize()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest_stream(stream: DataFrame, path: str, checkpoint: str, key: str, *version: str) -> StreamingQuery:
    """The highest version of each key as a Parquet table, rewritten after each micro-batch under path/<batch>."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        before = f"{path}/{number - 1}"
        rows = batch
        if number:
            rows = spark.read.parquet(before).unionByName(batch)
        dml.latest(rows, key, *version).write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
