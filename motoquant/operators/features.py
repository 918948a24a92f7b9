"""Feature columns for training, scoring and the processed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motoquant.config import DEFAULT, Rules
from motoquant.functions import health as H
from motoquant.functions import noise as N
from motoquant.functions.numeric import round_even
from motoquant.functions.vocab import canonical_class
from motoquant.operators.match import enrich


def engineer(df: DataFrame, key: list[str] | None = None, rules: Rules = DEFAULT) -> DataFrame:
    """Battery health and transmission offset; ``key`` columns seed the noise, none means no noise."""
    def draw(salt: str, std: float):
        return N.gaussian(key, salt, rules.seed, std) if key else None

    return df.withColumn(
        "battery_soh",
        H.battery_soh("fuel_type", "age", "mileage", draw("soh", rules.soh_noise_std), rules),
    ).withColumn(
        "trans_adapt_offset",
        H.transmission_offset("transmission", "mileage", draw("offset", rules.offset_noise_std), rules),
    )


def vehicle_health(df: DataFrame, key: list[str], rules: Rules = DEFAULT) -> DataFrame:
    """Annual mileage, drawn fault count, brake life and the wear health score, in that order."""
    return (
        df.withColumn("estimated_annual_mileage", H.annual_mileage("mileage", "age"))
        .withColumn(
            "dtc_fault_count",
            N.poisson(H.expected_faults("age", "mileage"), key, "faults", rules.seed),
        )
        .withColumn(
            "brake_life_pct",
            H.brake_life(
                "mileage", "front_brake", "rear_brake",
                N.gaussian(key, "brakes", rules.seed, rules.brake_noise_std),
            ),
        )
        .withColumn(
            "health_score",
            H.wear_health_score(
                "mileage", "battery_soh", "trans_adapt_offset", "dtc_fault_count", "brake_life_pct"
            ),
        )
    )


def score_ready(
    profiles: DataFrame, specs: DataFrame, rules: Rules = DEFAULT, market: str = "uk"
) -> DataFrame:
    """Scoring rows on the training path: class, specs, noise-free health signals.

    ``profiles``: profile_id, model, year, age, mileage, transmission, fuel_type, engine_size and
    optionally source_market.
    """
    given = F.col("source_market") if "source_market" in profiles.columns else F.lit(None).cast("string")
    size = F.col("engine_size").cast("double")
    listing = profiles.select(
        "profile_id",
        F.coalesce(canonical_class(F.col("model")), F.lit("Unknown")).alias("model_class"),
        F.col("year").cast("int").alias("year"),
        F.col("mileage").cast("double").alias("mileage"),
        "transmission", "fuel_type",
        size.alias("engine_size"), size.alias("engine_hint"),
        F.coalesce(given, F.lit(market)).alias("source_market"),
        F.col("age").cast("int").alias("age"),
    )
    return engineer(enrich(listing, specs, rules), None, rules)


def share_rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, round_even(c, digits))
    return df
