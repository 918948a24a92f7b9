"""Telemetry snapshots: parsing, health score, latest state. Works on batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motoquant.config import DEFAULT, Rules
from motoquant.functions.health import telemetry_health_score

SNAPSHOT = T.StructType([
    T.StructField("vehicle_id", T.LongType()),
    T.StructField("rpm", T.LongType()),
    T.StructField("coolant_c", T.DoubleType()),
    T.StructField("battery_v", T.DoubleType()),
    T.StructField("odo_km", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
])


def parse_snapshots(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines to snapshots; a line that is broken or lacks its key or time is dropped."""
    parsed = lines.select(F.from_json(F.col(column), SNAPSHOT, {"mode": "PERMISSIVE"}).alias("s")).select("s.*")
    needed = [F.col(c).isNotNull() for c in ("vehicle_id", "coolant_c", "battery_v", "ts")]
    keep = needed[0]
    for c in needed[1:]:
        keep = keep & c
    return parsed.filter(keep)


def fault_count(faults: DataFrame) -> DataFrame:
    """One row holding the number of known fault codes."""
    return faults.agg(F.count(F.lit(1)).alias("fault_count"))


def fault_count_per(faults: DataFrame, key: str) -> DataFrame:
    """Fault codes per vehicle profile."""
    return faults.groupBy(key).agg(F.count(F.lit(1)).alias("fault_count"))


def score_snapshots(events: DataFrame, vehicles: DataFrame, faults: DataFrame | None = None) -> DataFrame:
    """Snapshots with their health score.

    ``vehicles``: vehicle_id, services_done, services_due. ``faults``: a one-row count, or counts
    keyed by vehicle_id. The vehicle side is static, so a stream joins it without state.
    """
    joined = events.join(vehicles, "vehicle_id", "left")
    if faults is None:
        joined = joined.withColumn("fault_count", F.lit(0))
    elif "vehicle_id" in faults.columns:
        joined = joined.join(faults, "vehicle_id", "left")
    else:
        joined = joined.join(F.broadcast(faults))
    health = telemetry_health_score(
        "odo_km", "services_done", "services_due", F.coalesce("fault_count", F.lit(0)), "coolant_c", "battery_v"
    )
    return joined.withColumn("health", health).select(*events.columns, "health")


def latest_snapshot(events: DataFrame) -> DataFrame:
    """Newest snapshot per vehicle; equal times go to the larger reading, so reruns agree."""
    rest = [c for c in events.columns if c not in ("vehicle_id", "ts")]
    last = events.groupBy("vehicle_id").agg(F.max(F.struct("ts", *rest)).alias("r"))
    return last.select("vehicle_id", *[F.col(f"r.{c}").alias(c) for c in events.columns if c != "vehicle_id"])


__all__ = ["DEFAULT", "Rules", "SNAPSHOT", "fault_count", "fault_count_per", "latest_snapshot", "parse_snapshots", "score_snapshots"]
