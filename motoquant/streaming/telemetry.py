"""Telemetry as a stream: drop malformed events, score, keep the latest state per vehicle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from motoquant.operators.telemetry import SNAPSHOT, latest_snapshot, parse_snapshots, score_snapshots
from motoquant.sources.buckets import BucketTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
STATE_DAYS = 30  # a vehicle that is silent for so long leaves the state
BUCKETS = 64


def event_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def scored_stream(
    spark: SparkSession, path: str, vehicles: DataFrame, faults: DataFrame | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    return score_snapshots(parse_snapshots(event_lines(spark, path, files_per_batch)), vehicles, faults)


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; the checkpoint's offsets make a restart continue after it."""
    (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )


class Newest(StatefulProcessor):
    """Per vehicle the time of its newest event; lets through the rows that are as new or newer.

    One number per vehicle, which leaves the state when the vehicle has been silent for the time to
    live. An event that comes after that is let through again and compared by the table.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "at long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        top = self.state.get()[0] if self.state.exists() else None
        held: list[pd.DataFrame] = []
        for pdf in rows:
            high = int(pdf["at_us"].max())
            if top is None or high > top:
                top, held = high, []
            held.append(pdf[pdf["at_us"] == top])
        self.state.update((top,))
        yield from (pdf for pdf in held if len(pdf))

    def close(self) -> None:
        pass


def newest_events(stream: DataFrame, ttl_days: float = STATE_DAYS) -> DataFrame:
    """Rows of the stream that may be the latest of their vehicle.

    The other columns pass as text, so no type is changed on the way through the processor.
    """
    rest = [f for f in stream.schema.fields if f.name != "vehicle_id"]
    plain = stream.select("vehicle_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), *[F.col(f.name).cast("string") for f in rest])
    found = plain.groupBy("vehicle_id").transformWithStateInPandas(
        statefulProcessor=Newest(int(ttl_days * 86_400_000)), outputStructType=plain.schema, outputMode="Update", timeMode="ProcessingTime"
    )
    return found.select(*[F.col(f.name).cast(f.dataType) for f in stream.schema.fields])


def keep_latest(
    stream: DataFrame, path: str, checkpoint: str, ttl_days: float = STATE_DAYS, buckets: int = BUCKETS
) -> list[dict]:
    """Latest snapshot per vehicle, in a table of buckets by vehicle; returns the progress of the batches.

    Keyed state keeps out what is older than a vehicle's newest event, so a batch touches only the
    buckets of vehicles that moved on, and only these are rewritten. The table compares again, so it
    equals the batch form for any order of arrival and after any expiry.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    table = BucketTable(spark, path, "vehicle_id", T.StructType(stream.schema.fields), buckets)

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.merge(latest_snapshot(batch), batch_id, lambda stored, new: latest_snapshot(stored.unionByName(new)))

    # a processor with a time to live asks for another batch for ever; expiry waits for the next data instead
    before = spark.conf.get(NO_DATA_BATCHES, "true")
    spark.conf.set(NO_DATA_BATCHES, "false")
    try:
        query = (
            newest_events(stream, ttl_days).writeStream.outputMode("update").foreachBatch(merge)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(NO_DATA_BATCHES, before)
    query.awaitTermination()
    return query.recentProgress


def read_latest(spark: SparkSession, path: str, schema: T.StructType = SNAPSHOT) -> DataFrame:
    """The last committed version."""
    return BucketTable(spark, path, "vehicle_id", schema).read()
