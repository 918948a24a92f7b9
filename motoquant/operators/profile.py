"""Profiling and statistics; each returns a small long-form DataFrame."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motoquant.config import DEFAULT, Rules
from motoquant.functions.noise import uniform
from motoquant.operators.joins import add_group_count
from motoquant.operators.quantiles import exact_quantiles, melt_numeric, quantile_table, scan_columns


def _unpivot_row(row: DataFrame, items: list[tuple[str, dict[str, Column]]]) -> DataFrame:
    """A single aggregate row to one row per column name."""
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("column"), *[v.alias(k) for k, v in fields.items()])
        for name, fields in items
    ])))


def _melt_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])))


def _scanned(df: DataFrame, columns: list[str], probs: dict[str, float], also: dict) -> DataFrame:
    """Summaries and exact quantiles per column in two scans of the input."""
    found = scan_columns(df, columns, list(probs.values()), also)
    return found.drop("e", "n").join(quantile_table(df, columns, probs, scanned=found), "column")


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column."""
    also = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return _scanned(df, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, also).drop("n")


def text_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, unique, most frequent value and its frequency per text column."""
    counts = _melt_text(df, columns).filter(F.col("value").isNotNull()).groupBy(
        "column", "value"
    ).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("n")).alias("neg"), "value")).alias("best"),
    ).select("column", "count", "unique", F.col("best.value").alias("top"), (-F.col("best.neg")).alias("freq"))


def shape_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """1 to 99 percent quantiles, skewness, excess kurtosis, and skewness of log1p."""
    also = {"skew": F.skewness, "kurtosis": F.kurtosis, "log_skew": lambda v: F.skewness(F.log1p(v))}
    probs = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    return _scanned(df, columns, probs, also)


def duplicate_lens(df: DataFrame, lenses: dict[str, list[str]]) -> DataFrame:
    """Per named column set: rows that share their key, and rows beyond the first of each key.

    All sets are counted by one aggregation over grouping sets, in one shuffle of the rows.
    """
    columns = list(dict.fromkeys(c for own in lenses.values() for c in own))
    ids = {name: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in own) for name, own in lenses.items()}
    sets = {ids[name]: [F.col(f"`{c}`") for c in dict.fromkeys(own)] for name, own in lenses.items()}
    groups = df.groupingSets(list(sets.values()), *[F.col(f"`{c}`") for c in columns]).agg(
        F.count(F.lit(1)).alias("_rows"), F.grouping_id().alias("_set")
    )
    totals = groups.filter("_rows > 1").groupBy("_set").agg(F.sum("_rows").alias("rows"), F.sum(F.col("_rows") - 1).alias("extra"))
    named = df.sparkSession.createDataFrame(list(ids.items()), "lens string, _set long")
    return named.join(totals, "_set", "left").select(
        "lens", F.coalesce("rows", F.lit(0)).alias("duplicate_rows"), F.coalesce("extra", F.lit(0)).alias("extra_rows")
    )


def duplicate_rows(df: DataFrame, columns: list[str], rules: Rules = DEFAULT) -> DataFrame:
    """The rows that share their key with another row."""
    return add_group_count(df, columns, "copies", rules).filter("copies > 1")


def missing_by_column(df: DataFrame) -> DataFrame:
    row = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
    )
    items = [
        (c, {"missing": F.col(c), "pct": F.rint(F.col(c) * 10000.0 / F.col("_n")) / 100.0})
        for c in df.columns
    ]
    return _unpivot_row(row, items).filter("missing > 0").orderBy(F.desc("missing"), "column")


def missing_count(df: DataFrame, columns: list[str] | None = None) -> Column:
    parts = [F.col(c).isNull().cast("int") for c in (columns or df.columns)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def usable_rows(df: DataFrame) -> DataFrame:
    """Rows usable when up to k missing cells are tolerated; the window is over the k values only."""
    per_k = df.select(missing_count(df).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    top = per_k.agg(F.max("k").alias("top"))
    all_k = top.select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("k"))
    filled = all_k.join(per_k, "k", "left").na.fill(0, ["n"])
    run = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return filled.select(
        F.col("k").alias("max_missing_per_row"),
        F.sum("n").over(run).alias("usable_rows"),
        (F.rint(F.sum("n").over(run) * 1000.0 / F.sum("n").over(whole)) / 10.0).alias("pct"),
    )


def sparse_rows(df: DataFrame, thresholds: tuple[int, ...] = (30, 50, 70)) -> DataFrame:
    """Rows with more than the given share of their cells missing."""
    share = missing_count(df) * 100.0 / len(df.columns)
    row = df.select(share.alias("share")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col("share") > t).alias(f"t{t}") for t in thresholds],
    )
    return row.select(F.inline(F.array(*[
        F.struct(
            F.lit(t).alias("threshold_pct"), F.col(f"t{t}").alias("rows_above"),
            (F.rint(F.col(f"t{t}") * 1000.0 / F.col("_n")) / 10.0).alias("pct"),
        )
        for t in thresholds
    ])))


def impute(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """Missing numbers by the median, missing text by the most frequent value."""
    out = df
    if numeric:
        med = quantile_table(df, numeric, {"m": 0.5})
        row = med.agg(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(f"_m_{c}") for c in numeric])
        out = out.join(F.broadcast(row))
        for c in numeric:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"))).drop(f"_m_{c}")
    if text:
        top = text_summary(df, text)
        row = top.agg(*[F.max(F.when(F.col("column") == c, F.col("top"))).alias(f"_t_{c}") for c in text])
        out = out.join(F.broadcast(row))
        for c in text:
            out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_t_{c}"))).drop(f"_t_{c}")
    return out.select(*df.columns)


def imputation_effect(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """Numeric summaries before and after imputation."""
    before = numeric_summary(df, numeric).withColumn("stage", F.lit("before"))
    after = numeric_summary(impute(df, numeric, text), numeric).withColumn("stage", F.lit("after"))
    return before.unionByName(after)


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    q = quantile_table(df, columns, {"q1": 0.25, "q3": 0.75}).select(
        F.col("column").alias("_column"),
        (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low"),
        (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high"),
    )
    long = melt_numeric(df, columns)
    # one row per column name
    return long.join(F.broadcast(q), F.col("column") == F.col("_column")).groupBy("column").agg(
        F.count_if((F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))).alias("outliers"),
        (F.rint(F.max("low") * 10.0) / 10.0).alias("low"),
        (F.rint(F.max("high") * 10.0) / 10.0).alias("high"),
    )


def quality_checks(df: DataFrame, checks: dict[str, Column], constants: list[str]) -> DataFrame:
    """Rows failing each named check, and 1 for each column found constant."""
    row = df.agg(
        *[F.count_if(cond).alias(f"c{i}") for i, cond in enumerate(checks.values())],
        *[(F.min(c).eqNullSafe(F.max(c))).cast("bigint").alias(f"k{i}") for i, c in enumerate(constants)],
    )
    items = [(name, F.col(f"c{i}")) for i, name in enumerate(checks)]
    items += [(f"{c} constant", F.col(f"k{i}")) for i, c in enumerate(constants)]
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check"), v.cast("bigint").alias("count_or_flag")) for n, v in items
    ])))


def value_counts(df: DataFrame, columns: list[str], top: int = 8) -> DataFrame:
    """The most frequent values per column (null counts as a value) with the column's cardinality."""
    counts = _melt_text(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    unique = counts.groupBy("column").agg(F.count("value").alias("n_unique"))
    rank = Window.partitionBy("column").orderBy(F.desc("n"), F.col("value").asc_nulls_first())
    best = counts.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top)
    return best.join(F.broadcast(unique), "column").select("column", "rank", "value", "n", "n_unique")


def approx_cardinality(df: DataFrame, columns: list[str], error: float = 0.02) -> DataFrame:
    """Sketch-based distinct counts in one pass, for columns too wide for exact ones."""
    row = df.agg(*[F.approx_count_distinct(c, error).alias(c) for c in columns])
    return _unpivot_row(row, [(c, {"n_unique": F.col(c)}) for c in columns])


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins between the smallest and largest value; empty bins are listed."""
    v = F.col(column).cast("double")
    present = df.select(v.alias("v")).filter("v is not null")
    span = present.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    raw = F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))
    counts = (
        present.join(F.broadcast(span))
        .select(F.coalesce(F.least(raw, F.lit(bins - 1)), F.lit(0)).cast("int").alias("bin"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    )
    edges = span.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", width.alias("w"))
    return edges.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_low"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("bin_high"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
    )


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r of every unordered column pair, rows with either value missing left out."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[
        F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}")
        for i, (a, b) in enumerate(pairs)
    ])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ])))


def target_correlations(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Pearson r of each column with the target and with log1p of the target."""
    y = F.col(target).cast("double")
    row = df.agg(
        *[F.corr(F.col(c).cast("double"), y).alias(f"r{i}") for i, c in enumerate(columns)],
        *[F.corr(F.col(c).cast("double"), F.log1p(y)).alias(f"l{i}") for i, c in enumerate(columns)],
    )
    items = [(c, {"r": F.col(f"r{i}"), "r_log": F.col(f"l{i}")}) for i, c in enumerate(columns)]
    return _unpivot_row(row, items)


def strong_pairs(df: DataFrame, columns: list[str], threshold: float = 0.8) -> DataFrame:
    strong = correlations(df, columns).filter(F.abs("r") > threshold)
    return strong.orderBy(F.abs("r").desc(), "column_a", "column_b")


def correlation_ratio(df: DataFrame, categories: list[str], target: str) -> DataFrame:
    """Root share of the target's variance that lies between the categories' means."""
    y = F.col(target).cast("double")
    long = df.filter(y.isNotNull()).select(y.alias("y"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cat")) for c in categories
    ])))
    # shift by a common value first so that squares of large prices do not cancel
    shift = df.agg(F.avg(y).alias("shift"))
    shifted = long.join(F.broadcast(shift)).withColumn("y", F.col("y") - F.col("shift"))
    per_cat = shifted.groupBy("column", "cat").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss")
    )
    total = per_cat.groupBy("column").agg(
        F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("ss").alias("SS"),
        F.sum(F.when(F.col("cat").isNotNull(), F.col("n"))).alias("n_cat"),
        F.sum(F.when(F.col("cat").isNotNull(), F.col("s"))).alias("s_cat"),
        F.sum(F.when(F.col("cat").isNotNull(), F.col("s") * F.col("s") / F.col("n"))).alias("q_cat"),
    )
    mean = F.col("S") / F.col("N")
    between = F.col("q_cat") - 2.0 * mean * F.col("s_cat") + mean * mean * F.col("n_cat")
    spread = F.col("SS") - F.col("S") * mean
    eta = F.when(spread > 0, F.sqrt(F.greatest(between / spread, F.lit(0.0)))).otherwise(0.0)
    return total.select("column", eta.alias("eta"))


def group_boxes(df: DataFrame, category: str, value: str) -> DataFrame:
    """Quartiles, mean and range of the value per category, with the rank of its median."""
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    boxes = quantile_table(df, [value], probs, by=[category]).drop("column", "n")
    rest = df.groupBy(category).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"),
    )
    joined = rest.join(boxes.withColumnRenamed(category, "_cat"), F.col(category).eqNullSafe(F.col("_cat"))).drop("_cat")
    return joined.orderBy("median", category)


def variance_inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Uncentred variance inflation factors, largest first.

    One aggregate of pair products over the complete rows; only the k by k matrix of sums
    reaches the driver.
    """
    full = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = full.agg(*[
        F.sum(F.col(a) * F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)
    ]).first()
    k = len(columns)
    gram = np.zeros((k, k))
    for i, (a, b) in enumerate(pairs):
        ia, ib = columns.index(a), columns.index(b)
        gram[ia, ib] = gram[ib, ia] = sums[i] or 0.0
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1.0
    inverse = np.linalg.pinv(gram / np.outer(scale, scale))
    rows = sorted(zip(columns, (float(x) for x in np.diag(inverse))), key=lambda r: -r[1])
    return df.sparkSession.createDataFrame(rows, "column string, vif double")


def frequency_encode(df: DataFrame, column: str, name: str, rules: Rules = DEFAULT) -> DataFrame:
    """Row count of the row's own category; null for a missing category."""
    counted = add_group_count(df, [column], name, rules)
    return counted.withColumn(name, F.when(F.col(column).isNotNull(), F.col(name)))


def holdout_flag(df: DataFrame, key: list[str], share: float = 0.2, rules: Rules = DEFAULT) -> DataFrame:
    """Stable test flag from a hash of the key, the same after any repartitioning or retry."""
    return df.withColumn("is_test", uniform(key, "holdout", rules.seed) < share)


