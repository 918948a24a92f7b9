"""Comparable listings for many subjects at once, their median, and ordered reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motoquant.config import DEFAULT, Rules
from motoquant.functions.numeric import round_even, round_int


def _top_per_class_year(listings: DataFrame, limit: int, tie: str) -> DataFrame:
    """The cheapest ``limit`` listings of every class and year.

    Any year window takes its rows year by year in price order, so nothing past the first
    ``limit`` of a year can ever be returned. The rank filter is pushed below the shuffle as a
    group limit: a class holding a third of all listings sends at most ``limit`` rows per task.
    """
    order = Window.partitionBy("model", "year").orderBy(F.col("price_rm").asc(), F.col(tie).asc())
    return listings.withColumn("_rank", F.row_number().over(order)).filter(
        F.col("_rank") <= limit
    ).drop("_rank")


def _comps_by_key(
    keys: DataFrame, listings: DataFrame, limit: int, tie: str, rules: Rules
) -> DataFrame:
    """Kept listings per distinct (model, year) subject key, from the trimmed listings."""
    wide = rules.comps_wide_window
    trimmed = _top_per_class_year(listings.filter(F.col("model").isNotNull()), limit, tie)
    trimmed = trimmed.withColumnRenamed("year", "comp_year")

    dated = keys.filter(F.col("subject_year").isNotNull()).withColumn(
        "comp_year", F.explode(F.sequence(F.col("subject_year") - wide, F.col("subject_year") + wide))
    )
    near = dated.join(trimmed, ["model", "comp_year"], "inner").withColumn(
        "_tight", F.abs(F.col("comp_year") - F.col("subject_year")) <= rules.comps_year_window
    )
    undated = (
        keys.filter(F.col("subject_year").isNull())
        .join(trimmed, "model", "inner")
        .withColumn("_tight", F.lit(True))
        .select(near.columns)
    )
    pairs = near.unionByName(undated)
    # at most (2 * wide + 1) * limit rows per key meet here
    key = ["model", "subject_year"]
    by_rank = Window.partitionBy(*key).orderBy(
        F.col("comp_year").desc(), F.col("price_rm").asc(), F.col(tie).asc()
    )
    by_tight_rank = Window.partitionBy(*key, "_tight").orderBy(
        F.col("comp_year").desc(), F.col("price_rm").asc(), F.col(tie).asc()
    )
    whole = Window.partitionBy(*key)
    ranked = pairs.select(
        "*",
        F.row_number().over(by_rank).alias("_wide_rank"),
        F.row_number().over(by_tight_rank).alias("_tight_rank"),
        F.least(F.count_if(F.col("_tight")).over(whole), F.lit(limit)).alias("_n_tight"),
    )
    use_tight = (F.col("_n_tight") >= rules.comps_min_tight) | F.col("subject_year").isNull()
    rank = F.when(use_tight, F.col("_tight_rank")).otherwise(F.col("_wide_rank"))
    return (
        ranked.filter(F.col("_tight") | ~use_tight)
        .withColumn("comp_rank", rank)
        .filter(F.col("comp_rank") <= limit)
        .withColumn("year_window", F.when(use_tight, rules.comps_year_window).otherwise(wide))
        .drop("_tight", "_wide_rank", "_tight_rank", "_n_tight")
    )


def _safe_limit(limit: int | None, rules: Rules) -> int:
    return max(1, min(rules.comps_limit if limit is None else limit, rules.comps_limit_max))


def comps(
    subjects: DataFrame,
    listings: DataFrame,
    limit: int | None = None,
    tie: str = "listing_url",
    rules: Rules = DEFAULT,
) -> DataFrame:
    """Subject and kept-listing pairs.

    A subject's comparables depend on its (model, year) alone, so they are found once per
    distinct key and joined back. ``subjects`` needs subject_id, model, year.
    """
    kept = _safe_limit(limit, rules)
    keys = subjects.select("model", F.col("year").alias("subject_year")).distinct()
    found = _comps_by_key(keys, listings, kept, tie, rules)
    right = found.withColumnRenamed("model", "_m").withColumnRenamed("subject_year", "_y")
    on = (F.col("model") == F.col("_m")) & F.col("year").eqNullSafe(F.col("_y"))
    return subjects.join(right, on, "inner").drop("_m", "_y")


def comps_summary(
    subjects: DataFrame,
    listings: DataFrame,
    limit: int | None = None,
    tie: str = "listing_url",
    rules: Rules = DEFAULT,
    median_over: str = "kept",
) -> DataFrame:
    """Per subject: number of comparables, their median price and the subject's delta to it.

    The median is taken per (model, year) key over at most ``limit`` rows, then joined to the
    subjects, so the pairs themselves are never built. ``median_over="all"`` takes it over every
    listing of the chosen window instead of the kept ones.
    ``subjects`` needs subject_id, model, year, predicted_rm.
    """
    kept = _safe_limit(limit, rules)
    keys = subjects.select("model", F.col("year").alias("subject_year")).distinct()
    found = _comps_by_key(keys, listings, kept, tie, rules)
    per_key = found.groupBy("model", "subject_year").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("year_window").alias("year_window"),
        F.median("price_rm").alias("_median"),
    )
    if median_over == "all":
        per_key = _median_over_window(per_key, listings)
    right = per_key.withColumnRenamed("model", "_m").withColumnRenamed("subject_year", "_y")
    on = (F.col("model") == F.col("_m")) & F.col("year").eqNullSafe(F.col("_y"))
    median = round_int("_median")
    return subjects.join(right, on, "left").select(
        "subject_id", "model", "year",
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
        median.alias("median_rm"),
        F.when(
            median > 0, round_even((F.col("predicted_rm") - median) / median.cast("double"), 4)
        ).alias("delta_pct"),
    )


def _median_over_window(per_key: DataFrame, listings: DataFrame) -> DataFrame:
    """Exact median over all listings of the window, from counts per distinct price."""
    prices = listings.groupBy("model", F.col("year").alias("comp_year"), "price_rm").agg(
        F.count(F.lit(1)).alias("_c")
    )
    spans = per_key.filter(F.col("subject_year").isNotNull()).withColumn(
        "comp_year",
        F.explode(F.sequence(
            F.col("subject_year") - F.col("year_window"), F.col("subject_year") + F.col("year_window")
        )),
    )
    dated = spans.join(prices, ["model", "comp_year"])
    undated = per_key.filter(F.col("subject_year").isNull()).join(prices, "model")
    cols = ["model", "subject_year", "price_rm", "_c"]
    medians = (
        dated.select(*cols).unionByName(undated.select(*cols))
        .groupBy("model", "subject_year", "price_rm").agg(F.sum("_c").alias("_c"))
        .groupBy("model", "subject_year")
        .agg(F.expr("percentile(price_rm, 0.5D, _c)").alias("_all"))
        .select(F.col("model").alias("_mm"), F.col("subject_year").alias("_yy"), "_all")
    )
    on = (F.col("model") == F.col("_mm")) & F.col("subject_year").eqNullSafe(F.col("_yy"))
    return per_key.join(medians, on, "left").withColumn("_median", F.col("_all")).drop("_mm", "_yy", "_all")


def ordered_listings(listings: DataFrame, tie: str = "listing_id") -> DataFrame:
    """Source ascending, newest scrape first, then id; a range-partitioned global sort."""
    return listings.orderBy(F.col("source").asc(), F.col("scraped_at").desc(), F.col(tie).asc())
