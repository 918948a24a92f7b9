"""Training and pricing jobs."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motoquant.config import CATEGORICAL_FEATURES, DEFAULT, NUMERIC_FEATURES, TARGET, Rules
from motoquant.operators import bands, features, harmonise, match, model
from motoquant.sources import tables


def engineered(uk_raw: DataFrame, germany_raw: DataFrame, spec_raw: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Raw markets and specs to the training frame, one plan up to the write."""
    pooled = harmonise.pool(harmonise.harmonise_uk(uk_raw, rules), harmonise.harmonise_germany(germany_raw, rules))
    clean = harmonise.clean_pool(pooled, rules)
    enriched = match.enrich(clean, harmonise.clean_specs(spec_raw, rules), rules)
    # cleaned listings are distinct, so their own columns key the noise
    return features.engineer(enriched, ["model_class", "year", "mileage", "price_rm", "source_market"], rules)


def train(
    uk_raw: DataFrame, germany_raw: DataFrame, spec_raw: DataFrame, out: str, rules: Rules = DEFAULT,
    folds: int = 5, trees: int | None = None, depth: int | None = None,
) -> dict:
    """Write the engineered table, validate, fit on all rows, save model, tree table and report.

    The forests of the folds are fitted once, for metrics and band coverage alike.
    """
    spark = uk_raw.sparkSession
    # the written table settles the row ids
    rows = engineered(uk_raw, germany_raw, spec_raw, rules).withColumn("row_id", F.monotonically_increasing_id())
    tables.write_table(rows, f"{out}/engineered")
    table = spark.read.parquet(f"{out}/engineered")
    frame = model.model_frame(table, CATEGORICAL_FEATURES, NUMERIC_FEATURES, [TARGET, "row_id"])
    held = model.out_of_fold(frame, f"{out}/folds", rules, folds, trees, depth, key=["row_id"])
    _, report = model.cross_validate(frame, rules, folds, trees, depth, held=held)
    coverage = model.band_coverage(frame, f"{out}/folds", rules, folds, trees, depth, held=held)
    fitted = model.fit(frame, model.forest(rules, trees=trees, depth=depth))
    params = {"trees": trees or rules.forest_trees, "depth": depth or rules.forest_depth, "min_leaf": rules.forest_min_leaf}
    summary = tables.model_report(report, coverage, table, params, rules)
    tables.save_model(fitted, summary, out, spark)
    tables.write_table(model.tree_table(spark, f"{out}/model"), f"{out}/trees")
    return summary


def train_log(
    table: DataFrame, out: str, rules: Rules = DEFAULT, folds: int = 5, trees: int | None = None, depth: int | None = None,
    min_leaf: int | None = None,
) -> dict:
    """Fit the forest of log prices on the engineered table, with a band calibrated on held-out groups.

    k is the number of deviations that holds the wanted share of out-of-fold prices; the reported coverage
    of a fold uses the k of the other folds. Model, tree table and report go to ``out``/log.
    """
    spark = table.sparkSession
    trees, min_leaf = trees or rules.log_forest_trees, min_leaf or rules.log_forest_min_leaf
    frame = model.model_frame(table, CATEGORICAL_FEATURES, NUMERIC_FEATURES, [TARGET, "row_id"]).withColumn(model.LOG_TARGET, F.log1p(TARGET))
    held = model.out_of_fold(frame, f"{out}/log/folds", rules, folds, trees, depth, min_leaf, key=["row_id"], label=model.LOG_TARGET)
    n, k = bands.conformal_scale(held, TARGET, rules=rules).select("n", "k").first()
    if k == float("inf"):
        raise ValueError("too many held-out prices differ from trees that all agree: no k holds the wanted share")
    per_fold = bands.conformal_coverage(held, TARGET, "fold", rules=rules).collect()
    fitted = model.fit(frame, model.forest(rules, model.LOG_TARGET, trees, depth, min_leaf))
    summary = {
        "target": "log1p", "k": k, "n_rows": n, "coverage_wanted": rules.log_coverage,
        "coverage_measured": sum(r["n"] * r["coverage"] for r in per_fold) / max(1, sum(r["n"] for r in per_fold)),
        "folds": [r.asDict() for r in per_fold], "params": {"trees": trees, "depth": depth or rules.forest_depth, "min_leaf": min_leaf},
    }
    tables.save_model(fitted, summary, f"{out}/log", spark)
    tables.write_table(model.tree_table(spark, f"{out}/log/model"), f"{out}/log/trees")
    return summary


def price(spark: SparkSession, out: str, profiles: DataFrame, specs: DataFrame, rules: Rules = DEFAULT, log: bool = False) -> DataFrame:
    """Value and band of every profile with the saved model; scoring shares the training path.

    ``log``: with the forest of log prices and its calibrated band, which ``train_log`` has saved.
    """
    out = f"{out}/log" if log else out
    ready = features.score_ready(profiles, specs, rules)
    frame = model.model_frame(ready, CATEGORICAL_FEATURES, NUMERIC_FEATURES, ["profile_id"])
    scored = PipelineModel.load(f"{out}/model").transform(frame)
    valued = model.with_tree_values(scored, spark.read.parquet(f"{out}/trees"), ["profile_id"], rules)
    if log:
        valued = bands.calibrated_band(valued, rules=rules, k=tables.load_report(out, spark)["k"])
    else:
        valued = bands.percentile_band(valued, rules=rules)
    return valued.select("profile_id", "value_rm", "low_rm", "high_rm", "confidence")
