"""Readers and writers: raw CSV scans, page scans, table sinks, exports, append with resume."""

from __future__ import annotations

import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motoquant.config import DEFAULT, Rules
from motoquant.functions.vocab import class_label
from motoquant.functions.numeric import to_number

# Raw column names of the source files.
UK_COLUMNS = ["model", "year", "price", "transmission", "mileage", "fuelType", "tax", "mpg", "engineSize"]
GERMANY_COLUMNS = ["brand", "model", "year", "price_in_euro", "transmission_type", "fuel_type", "mileage_in_km"]
US_COLUMNS = ["manufacturer", "model", "year", "price", "odometer", "transmission", "fuel"]
SPEC_COLUMNS = [
    "Model", "Serie", "Company", "Body style", "Production years", "Cylinders", "Displacement", "Power(HP)",
    "Torque(Nm)", "Fuel System", "Fuel", "Top Speed", "Acceleration 0-62 Mph (0-100 kph)", "Drive Type",
    "Gearbox", "Front brake", "Rear brake", "Cargo Volume",
]

# Export column contracts.
FEATURE_COLUMNS = [
    "source", "listing_url", "model", "year", "age", "mileage", "price_rm", "transmission", "fuel_type",
    "engine_size", "variant", "location", "seller_type", "posted_at", "scraped_at",
]
SPEC_SHAPE_COLUMNS = [
    "specific model of the car", "engine type", "engine cc", "engine aspiration", "gear type/transmission",
    "number of gears", "top speed (km/h)", "front brakes", "rear brakes", "front suspension",
    "rear suspension", "boot space (litres)", "seat capacity", "number of doors", "torque (Nm)",
    "time for 0-100 km/h (s)", "mileage", "fuel type", "year of the car", "price (RM)",
]
COMPACT_COLUMNS = [
    "source", "listing_url", "specific model of the car", "gear type/transmission", "mileage", "fuel type",
    "year of the car", "price (RM)", "variant", "location", "seller_type", "posted_at", "scraped_at",
]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared folder; an error where none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Share out an input that has fewer partitions than there are cores, such as one small file.

    Looks at the planned partition count only. An input of many files or row groups is left as it
    is, so on large tables this adds no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: lineage ends there and outlives an executor."""
    path = shared_dir(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- scans -----------------------------------------------------------------------------------


def read_text_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with header, every column text, nothing inferred.

    Columns are found by header name, so files may order them differently or carry more.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", False)
    found = reader.option("inferSchema", False).csv(path)
    if columns is None:
        return found
    have = set(found.columns)
    return found.select(*[
        F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in columns
    ])


def read_uk(spark: SparkSession, path: str) -> DataFrame:
    return read_text_table(spark, path, UK_COLUMNS)


def read_germany(spark: SparkSession, path: str) -> DataFrame:
    return read_text_table(spark, path, GERMANY_COLUMNS)


def read_us(spark: SparkSession, path: str) -> DataFrame:
    return read_text_table(spark, path, US_COLUMNS)


def file_position() -> Column:
    """Sortable position of a row in its files: path, block, order within the read.

    Rows of one block keep their order within a task, so the struct follows file order whichever
    task reads the block.
    """
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return F.struct(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        within.alias("row"),
    )


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """Spec rows as text with their file position for tie order."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return raw.select(*[F.col(f"`{c}`") for c in SPEC_COLUMNS], file_position().alias("spec_pos"))


def read_pages(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Stored pages: a parquet table with url and html, or a folder of one HTML file per page."""
    if form == "parquet":
        return spark.read.parquet(path)
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


# --- sinks -----------------------------------------------------------------------------------


def write_table(df: DataFrame, path: str, form: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Replace the table."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if form == "csv":
        writer.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False
        ).csv(path)
    else:
        writer.parquet(path)


def market_features(listings: DataFrame, year: int) -> DataFrame:
    """The feature projection of stored listings; engine size is not known from a listing."""
    known = {"age": (F.lit(year) - F.col("year")).cast("int"), "engine_size": F.lit(None).cast("double")}
    return listings.orderBy(F.asc("source"), F.desc("scraped_at"), F.asc("listing_id")).select(
        *[known[c].alias(c) if c in known else F.col(c) for c in FEATURE_COLUMNS]
    )


def spec_shape(listings: DataFrame, compact: bool = False) -> DataFrame:
    """Listings in the spec-sheet column contract, technical columns null."""
    named = F.concat_ws(" ", "model", F.nullif(F.col("variant"), F.lit("")))
    known = {
        "specific model of the car": named, "gear type/transmission": F.col("transmission"),
        "mileage": F.col("mileage"), "fuel type": F.col("fuel_type"), "year of the car": F.col("year"),
        "price (RM)": F.col("price_rm"),
    }
    ordered = listings.orderBy(F.asc("source"), F.desc("scraped_at"), F.asc("listing_id"))
    if compact:
        return ordered.select(*[known.get(c, F.col(c)).alias(c) for c in COMPACT_COLUMNS])
    none = F.lit(None).cast("string")
    return ordered.select(*[known.get(c, none).alias(c) for c in SPEC_SHAPE_COLUMNS])


def spec_shape_summary(shape: DataFrame) -> DataFrame:
    """Rows, rows without any technical spec, and gaps of the listing columns."""
    technical = [c for c in SPEC_SHAPE_COLUMNS if c not in (
        "specific model of the car", "gear type/transmission", "mileage", "fuel type", "year of the car", "price (RM)",
    )]
    all_null = F.coalesce(*[F.col(f"`{c}`").cast("string") for c in technical]).isNull()
    return shape.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(all_null).alias("missing_technical_specs"),
        F.count_if(F.col("`gear type/transmission`").isNull()).alias("missing_transmission"),
        F.count_if(F.col("`fuel type`").isNull()).alias("missing_fuel_type"),
        F.count_if(F.col("mileage").isNull()).alias("missing_mileage"),
    )


def not_yet_written(new: DataFrame, existing: DataFrame, key: str = "source_url") -> DataFrame:
    """New rows whose key the output lacks, once per key."""
    rest = [c for c in new.columns if c != key]
    once = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*").select(*new.columns)
    return once.join(existing.select(key).distinct(), key, "left_anti")


def append_with_resume(new: DataFrame, path: str, key: str = "source_url") -> int:
    """Append rows with unseen keys to a parquet table; returns how many were added."""
    spark = new.sparkSession
    reader = spark.read.schema(new.schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    existing = reader.parquet(path) if there else spark.createDataFrame([], new.schema)
    # settle the selection first: it must not be re-evaluated while the table grows
    todo = materialise(not_yet_written(new, existing, key), "resume")
    added = todo.count()
    if added:
        todo.write.mode("append").parquet(path)
    return added


DROP_REASONS = ["kept", "numeric_only", "sanity_filter"]


def training_rows(raw: DataFrame, year: int, fx: float) -> DataFrame:
    """Single-market load: label, price and age, with the reason a row would be dropped."""
    y, price = to_number("year").cast("int"), to_number("price")
    km, litres = to_number("mileage"), to_number("engineSize")
    label = class_label("model")
    numeric_only = F.trim(F.col("model")).rlike(r"^\d+$")
    sane = (
        y.between(1970, year) & (price > 0) & (km >= 0) & (litres >= 0) & label.isNotNull()
    )
    reason = F.when(numeric_only, "numeric_only").when(F.coalesce(sane, F.lit(False)), "kept").otherwise("sanity_filter")
    return raw.select(
        label.alias("model"), y.alias("year"), (F.lit(year) - y).alias("age"), km.cast("bigint").alias("mileage"),
        F.rint(price * fx).cast("bigint").alias("price_rm"), "transmission",
        F.col("fuelType").alias("fuel_type"), litres.alias("engine_size"), reason.alias("reason"),
    )


def load_ledger(rows: DataFrame) -> DataFrame:
    """Rows in, dropped by reason and written, with the written price range."""
    kept = F.col("reason") == "kept"
    return rows.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(F.col("reason") == "numeric_only").alias("rows_dropped_numeric_only"),
        F.count_if(F.col("reason") == "sanity_filter").alias("rows_dropped_sanity_filter"),
        F.count_if(kept).alias("rows_written"),
        F.min(F.when(kept, F.col("price_rm"))).alias("price_rm_min"),
        F.max(F.when(kept, F.col("price_rm"))).alias("price_rm_max"),
    )


def reload_training(raw: DataFrame, path: str, year: int, fx: float) -> DataFrame:
    """Replace the training table and return the ledger."""
    rows = training_rows(raw, year, fx)
    write_table(rows.filter("reason = 'kept'").drop("reason"), path)
    return load_ledger(rows)


def save_model(model: PipelineModel, report: dict, path: str, spark: SparkSession) -> None:
    """Pipeline and a one-row JSON report next to it."""
    model.write().overwrite().save(f"{path}/model")
    schema = T.StructType([T.StructField("report", T.StringType())])
    row = spark.createDataFrame([(json.dumps(report, default=str),)], schema)
    row.coalesce(1).write.mode("overwrite").text(f"{path}/report")


def load_report(path: str, spark: SparkSession) -> dict:
    return json.loads(spark.read.text(f"{path}/report").first()[0])


def model_report(metrics: DataFrame, coverage: DataFrame, trained_on: DataFrame, params: dict, rules: Rules = DEFAULT) -> dict:
    """What the trained model's JSON holds; markets are those actually present."""
    markets = {r["source_market"]: r["count"] for r in trained_on.groupBy("source_market").count().collect()}
    return {
        "models": [r.asDict() for r in metrics.collect()],
        "interval": coverage.first().asDict(),
        "params": params,
        "mape_floor_rm": rules.mape_floor_rm,
        "fx_rates": {"gbp_to_rm": rules.fx_gbp, "eur_to_rm": rules.fx_eur, "usd_to_rm": rules.fx_usd},
        "source_markets": markets,
        "n_rows": sum(markets.values()),
    }
