"""Row contracts: named rules, a quarantine split and one-pass violation counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motoquant.config import DEFAULT, Rules


@dataclass(frozen=True)
class Rule:
    name: str
    holds: Column


def _at_least(column: str, low: float, required: bool) -> Column:
    ok = F.col(column) >= low
    return F.coalesce(ok, F.lit(not required))


def _between(column: str, low: float, high: float) -> Column:
    return F.coalesce(F.col(column).between(low, high), F.lit(False))


def profile_rules() -> list[Rule]:
    return [
        Rule("year 1970-2100", _between("year", 1970, 2100)),
        Rule("mileage >= 0", _at_least("mileage", 0, True)),
        Rule("engine_size >= 0", _at_least("engine_size", 0, True)),
        Rule("original_purchase_price_rm >= 0", _at_least("original_purchase_price_rm", 0, False)),
        Rule("service_history_count >= 0", _at_least("service_history_count", 0, False)),
        Rule("service_history_total >= 0", _at_least("service_history_total", 0, False)),
    ]


def listing_rules(rules: Rules = DEFAULT) -> list[Rule]:
    return [
        Rule("known source", F.coalesce(F.col("source").isin(*rules.sources), F.lit(False))),
        Rule("has url", F.col("listing_url").isNotNull()),
        Rule("has model", F.col("model").isNotNull()),
        Rule("has year", F.col("year").isNotNull()),
        Rule("has price", F.col("price_rm").isNotNull()),
    ]


def telemetry_rules() -> list[Rule]:
    return [
        Rule("health 0-100", _between("health", 0, 100)),
        Rule("has timestamp", F.col("ts").isNotNull()),
    ]


def first_violation(contract: list[Rule]) -> Column:
    return F.coalesce(*[F.when(~r.holds, F.lit(r.name)) for r in contract], F.lit(None).cast("string"))


def split_by_contract(df: DataFrame, contract: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and quarantined rows with the first rule they break."""
    flagged = df.withColumn("violation", first_violation(contract))
    good = flagged.filter(F.col("violation").isNull()).drop("violation")
    return good, flagged.filter(F.col("violation").isNotNull())


def contract_counts(df: DataFrame, contract: list[Rule]) -> DataFrame:
    """Rows breaking each rule, all rules counted in one aggregate."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(~r.holds).alias(f"r{i}") for i, r in enumerate(contract)],
    )
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("violations"), F.col("n").alias("rows_checked"))
        for i, r in enumerate(contract)
    ])))
