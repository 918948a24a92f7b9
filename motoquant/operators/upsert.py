"""Keyed upsert, capped priority union, run summaries and fault-code flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motoquant.config import DEFAULT, Rules
from motoquant.sources.buckets import BucketTable

UPDATED_FIELDS = [
    "model", "variant", "year", "price_rm", "mileage", "transmission",
    "fuel_type", "location", "seller_type", "posted_at", "scraped_at",
]


def latest_per_key(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row of each key by ``order``, folded with map-side combine."""
    rest = [c for c in batch.columns if c not in keys and c not in order]
    last = batch.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in batch.columns])


def upsert(
    state: DataFrame,
    batch: DataFrame,
    order: list[str],
    key: str = "listing_url",
    fields: list[str] | None = None,
) -> DataFrame:
    """State after the batch: listed fields taken from the batch where the key exists in it.

    Columns outside ``fields`` keep their first stored value, so the source of a listing does
    not change on update. A key repeated inside the batch counts once, its last row winning.
    """
    fields = UPDATED_FIELDS if fields is None else fields
    new = latest_per_key(batch, [key], order)
    b = new.select(F.col(key), *[F.col(c).alias(f"_b_{c}") for c in new.columns if c != key],
                   F.lit(True).alias("_in_batch"))
    s = state.withColumn("_in_state", F.lit(True))
    joined = s.join(b, key, "full_outer")

    def pick(c: str) -> Column:
        if c == key:
            return F.col(key)
        if f"_b_{c}" not in b.columns:
            return F.col(c)
        if c in fields:
            return F.when(F.col("_in_batch"), F.col(f"_b_{c}")).otherwise(F.col(c))
        return F.when(F.col("_in_state"), F.col(c)).otherwise(F.col(f"_b_{c}"))

    return joined.select(*[pick(c).alias(c) for c in state.columns])


def upsert_buckets(
    table: BucketTable, batch: DataFrame, version: int, order: list[str], fields: list[str] | None = None
) -> set[int]:
    """``upsert`` into a table of hash buckets: reads and rewrites only the buckets that the batch touches.

    The batch is folded to one row per key first. Returns the rewritten buckets.
    """
    new = latest_per_key(batch, [table.key], order)
    return table.merge(new, version, lambda stored, rows: upsert(stored, rows, order, table.key, fields))


def capped_union(
    first: DataFrame, second: DataFrame, cap: int | None, order: list[str]
) -> DataFrame:
    """First source up to the cap, the second fills what is left; top-k per partition, then merged.

    Without a cap all rows are kept.
    """
    if cap is None:
        return first.unionByName(second)
    both = first.withColumn("_source_rank", F.lit(0)).unionByName(
        second.withColumn("_source_rank", F.lit(1))
    )
    return both.orderBy("_source_rank", *order).limit(cap).drop("_source_rank")


def run_summary(
    outcomes: DataFrame, stored: DataFrame, pages: DataFrame | None = None, sources: list[str] | None = None
) -> DataFrame:
    """Per source: status and error, row outcomes, rows stored and their gaps, with the grand total stored.

    ``outcomes``: source, outcome (kept, other_brand, unparseable). ``stored``: listings written.
    ``pages``: source, status, one row per stored page. ``sources``: names listed even without rows.
    A source of which no page is good has ``fetch_failed`` and its kinds of bad pages as error; kept rows
    that are not stored, for a cap or a repeated URL, count as ``capped``.
    """
    spark = outcomes.sparkSession
    seen = outcomes.groupBy("source").agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count_if(F.col("outcome") != "kept").alias("skipped"),
        F.count_if(F.col("outcome") == "kept").alias("_kept"),
    )
    kept = stored.groupBy("source").agg(
        F.count(F.lit(1)).alias("stored"),
        F.count_if(F.col("transmission").isNull()).alias("missing_transmission"),
        F.count_if(F.col("fuel_type").isNull()).alias("missing_fuel_type"),
        F.count_if(F.col("mileage").isNull()).alias("missing_mileage"),
    )
    pages = spark.createDataFrame([], "source string, status string") if pages is None else pages
    bad = F.col("status") != "ok"
    read = pages.groupBy("source").agg(
        F.count_if(bad).alias("bad_pages"), F.count_if(~bad).alias("_good"),
        F.array_join(F.array_sort(F.collect_set(F.when(bad, F.col("status")))), ", ").alias("_kinds"),
    )
    named = spark.createDataFrame([(s,) for s in sources or []], "source string")
    joined = seen.join(kept, "source", "full_outer").join(read, "source", "full_outer").join(named, "source", "full_outer").na.fill(0)
    failed = (F.col("bad_pages") > 0) & (F.col("_good") == 0)
    total = stored.agg(F.count(F.lit(1)).alias("total_stored"))
    # one-row total on every source row
    return joined.join(F.broadcast(total)).select(
        "source", F.when(failed, "fetch_failed").otherwise("ok").alias("status"),
        F.when(failed, F.col("_kinds")).otherwise("").alias("error"), "fetched", "skipped", "stored",
        (F.col("_kept") - F.col("stored")).alias("capped"), "bad_pages",
        "missing_transmission", "missing_fuel_type", "missing_mileage", "total_stored",
    )


def fault_codes(layers: DataFrame) -> DataFrame:
    """Nested diagnostic layers to one row per code.

    ``layers``: source_file, layer, dtcs array of (trouble_code, short_name, display_code, text),
    services array of (short_name, responses array). A file without any formal code yields a
    single info row from its first status service.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    # explode_outer keeps no row: layers without codes are handled by the fallback below
    formal = (
        layers.select("source_file", "layer", F.posexplode("dtcs").alias("pos", "d"))
        .select(
            "source_file",
            F.coalesce(blank(F.col("d.trouble_code")), blank(F.col("d.short_name"))).alias("code"),
            F.coalesce(
                F.nullif(F.col("d.display_code"), F.lit("")),
                F.nullif(F.col("d.text"), F.lit("")),
                F.col("d.short_name"),
            ).alias("description"),
            F.lit("warn").alias("severity"),
            F.col("layer").alias("system"),
            "pos",
        )
        .filter(F.col("code").isNotNull())
    )
    names = F.array_join("s.responses", ", ")
    status = (
        layers.select("source_file", "layer", F.posexplode("services").alias("pos", "s"))
        .filter(F.col("s.short_name") == "report_status")
        .groupBy("source_file")
        .agg(F.min(F.struct("layer", "pos", names.alias("names"))).alias("first"))
        .select(
            "source_file",
            F.lit("ODX-REPORT-STATUS").alias("code"),
            F.concat(
                F.lit("ODX diagnostic service exposes "),
                F.coalesce(F.nullif(F.col("first.names"), F.lit("")), F.lit("status data")),
            ).alias("description"),
            F.lit("info").alias("severity"),
            F.col("first.layer").alias("system"),
            F.lit(0).alias("pos"),
        )
    )
    fallback = status.join(formal.select("source_file").distinct(), "source_file", "left_anti")
    return formal.unionByName(fallback)


def upsert_fault_codes(state: DataFrame, faults: DataFrame) -> DataFrame:
    """Insert or update by code; the last row of the batch for a code wins."""
    batch = faults.select("code", "description", "severity", "system", "source_file", "pos")
    return upsert(
        state, batch, ["source_file", "system", "pos"], key="code",
        fields=["description", "severity", "system"],
    )


__all__ = [
    "DEFAULT", "Rules", "capped_union", "fault_codes", "latest_per_key",
    "run_summary", "upsert", "upsert_fault_codes",
]
