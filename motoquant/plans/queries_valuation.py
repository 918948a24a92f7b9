"""Queries: curves, advice, models, bands, metrics (R59-R77) and sinks (R01-R09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motoquant.config import CATEGORICAL_FEATURES, NUMERIC_FEATURES, SIMULATED_FEATURES, TARGET
from motoquant.functions.numeric import round_even
from motoquant.operators import bands as B
from motoquant.operators import curves as C
from motoquant.operators import features as FT
from motoquant.operators import forest as FO
from motoquant.operators import metrics as MT
from motoquant.operators import model as ML
from motoquant.operators.features import share_rounded
from motoquant.plans.queries_core import enriched
from motoquant.plans.sqltext import class_label, r_even, rint
from motoquant.plans.standins import SQL, ctes, frame
from motoquant.sources import tables as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# small forest for the registered runs; the size is a parameter, the rows are all rows
TREES, DEPTH = 8, 6


def training_frame(s: SparkSession, d: str) -> DataFrame:
    """Engineered listings, written once because every fit reads them many times."""
    df = FT.vehicle_health(FT.engineer(enriched(s, d), ["row_key"]), ["row_key"])
    frame_ = ML.model_frame(
        df, CATEGORICAL_FEATURES, NUMERIC_FEATURES + SIMULATED_FEATURES[2:], ["row_key", "part_key", "supp_key", TARGET]
    )
    return S.materialise(frame_, "training")


def _fitted(s: SparkSession, d: str):
    train = training_frame(s, d)
    model = ML.fit(train, ML.forest(trees=TREES, depth=DEPTH))
    return train, model


# --- curves and advice -----------------------------------------------------------------------


def _rate(s: SparkSession, d: str) -> DataFrame:
    return C.rate_curve(frame(s, d, "profile"), 5)


FACTORS = ", ".join(f"({n}, CAST('{v}' AS DECIMAL(19,18)))" for n, v in [
    (n, f"{__import__('decimal').Decimal('0.95') ** n:.18f}") for n in range(60)
])
RATE = f"""{ctes('profile')}, f(n, k) AS (VALUES {FACTORS}),
p AS (SELECT profile_id, year, coalesce(original_purchase_price_rm, predicted_rm) AS price, greatest(0, 2026 - year) AS age FROM profile),
c AS (SELECT p.profile_id, CAST(i AS INTEGER) AS step, CAST(2026 + i AS INTEGER) AS year,
  CAST(round(CAST(price AS DECIMAL(18,0)) * f.k, 0) AS BIGINT) AS value_rm, price
  FROM p CROSS JOIN range(6) t(i) JOIN f ON f.n = p.age + i),
curve AS (SELECT profile_id, step, year, value_rm, {r_even('value_rm / CAST(price AS DOUBLE)', 4)} AS retained_pct FROM c)"""
QUERIES["r60_rate_curve"] = _rate
ORACLES["r60_rate_curve"] = f"{RATE} SELECT * FROM curve"

QUERIES["r73_repair_or_sell"] = lambda s, d: C.advise(None, _rate(s, d), "horizon")
ORACLES["r73_repair_or_sell"] = f"""{RATE}, e AS (SELECT profile_id, max(value_rm) FILTER (WHERE step = 0) AS a, max(value_rm) FILTER (WHERE step = 5) AS b
  FROM curve GROUP BY 1), l AS (SELECT *, greatest(0, a - b) AS loss FROM e)
SELECT profile_id, a AS current_value_rm, b AS horizon_value_rm, CAST(5 AS INTEGER) AS horizon_years, loss AS depreciation_loss_rm,
  CAST(18400 AS BIGINT) AS total_repair_cost_rm, CASE WHEN 18400 < loss THEN 'Repair and keep' ELSE 'Sell' END AS recommendation,
  CASE WHEN 18400 < loss THEN 'Repair and keep is recommended because the estimated repair bundle of RM 18,400 is lower than the projected 5-year depreciation loss of RM '
    ELSE 'Selling is recommended because the estimated repair bundle of RM 18,400 is not lower than the projected 5-year depreciation loss of RM ' END
    || format('{{:,}}', loss) || '.' AS summary FROM l"""

QUERIES["r74_dashboard_advice"] = lambda s, d: C.advise(
    frame(s, d, "profile").select(
        "profile_id", F.col("predicted_rm").alias("value_rm"), F.lit(0.92).alias("confidence"),
        F.when(F.col("profile_id") % 3 != 0, (F.col("profile_id") % 100).cast("int")).alias("health"),
    ), _rate(s, d), "dashboard",
)
ORACLES["r74_dashboard_advice"] = f"""{RATE}, j AS (SELECT p.profile_id, p.predicted_rm AS v, k.value_rm AS later,
  CASE WHEN p.profile_id % 3 <> 0 THEN p.profile_id % 100 ELSE 87 END AS health
  FROM profile p JOIN curve k ON k.profile_id = p.profile_id AND k.step = 2)
SELECT profile_id, greatest(0, v - later) AS depreciation_loss_rm, greatest(0, greatest(0, v - later) - 18400) AS advantage_rm,
  CAST(least(greatest(floor(CAST(0.92 AS DOUBLE) * 78 + health * CAST(0.22 AS DOUBLE) + CAST(0.5 AS DOUBLE)), 55), 92) AS INTEGER) AS confidence_pct,
  CASE WHEN greatest(0, v - later) > 18400 AND health >= 65 THEN 'Sell or inspect first' ELSE 'Repair & keep' END AS recommendation FROM j"""

QUERIES["r72_flat_band"] = lambda s, d: B.flat_band(
    frame(s, d, "profile").select("profile_id", "predicted_rm"), "predicted_rm"
)
ORACLES["r72_flat_band"] = f"""{ctes('profile')} SELECT profile_id, predicted_rm, predicted_rm AS value_rm,
  CAST({rint('predicted_rm * CAST(0.92 AS DOUBLE)')} AS BIGINT) AS low_rm, CAST({rint('predicted_rm * CAST(1.08 AS DOUBLE)')} AS BIGINT) AS high_rm,
  CAST(0.92 AS DOUBLE) AS confidence FROM profile"""


def _model_curve(s: SparkSession, d: str) -> DataFrame:
    train, model = _fitted(s, d)
    scored = FT.score_ready(frame(s, d, "profile"), frame(s, d, "spec"))
    steps = FT.engineer(C.age_steps(scored, 5))
    base = ML.model_frame(steps, CATEGORICAL_FEATURES, NUMERIC_FEATURES, ["profile_id", "year", "step"])
    return C.model_curve(model.transform(base))


QUERIES["r59_model_curve"] = _model_curve

# --- metrics and folds -----------------------------------------------------------------------

ERR = f"""{ctes('listing')}, e AS (SELECT source_market, CAST(price_rm AS DOUBLE) AS y,
  CAST(price_rm AS DOUBLE) * (CAST(0.9 AS DOUBLE) + (row_key % 7) * CAST(0.03 AS DOUBLE)) AS p FROM listing)"""
QUERIES["r66_metrics"] = lambda s, d: share_rounded(
    MT.regression_metrics(
        frame(s, d, "listing").withColumn("p", F.col("price_rm") * (0.9 + (F.col("row_key") % 7) * 0.03)),
        "price_rm", "p", ["source_market"],
    ), ["mae", "rmse", "r2", "mape"], 5,
)
ORACLES["r66_metrics"] = f"""{ERR} SELECT source_market, count(*) AS n, {r_even('avg(abs(y - p))', 5)} AS mae,
  {r_even('sqrt(avg((y - p) * (y - p)))', 5)} AS rmse, {r_even('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))', 5)} AS r2,
  {r_even('100 * avg(abs((y - p) / y)) FILTER (WHERE y >= 5000)', 5)} AS mape FROM e GROUP BY 1"""

QUERIES["r64_group_folds"] = lambda s, d: MT.group_folds(frame(s, d, "listing"), "model_class").groupBy(
    "model_class", "fold"
).agg(F.count(F.lit(1)).alias("n"))
ORACLES["r64_group_folds"] = f"""{ctes('listing').replace('WITH ', 'WITH RECURSIVE ', 1)},
g AS (SELECT model_class, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, model_class DESC NULLS LAST) AS i FROM listing GROUP BY 1),
w(i, loads, fold) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], -1
  UNION ALL SELECT g.i, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + g.n ELSE x END),
    CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER) FROM w JOIN g ON g.i = w.i + 1)
SELECT g.model_class, CAST(w.fold AS INTEGER) AS fold, g.n FROM w JOIN g ON g.i = w.i"""

# --- bands from tree values ------------------------------------------------------------------


def _tree_standin(s: SparkSession, d: str) -> DataFrame:
    """Each order's line prices stand for the trees of one prediction."""
    return frame(s, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.col("l_extendedprice") * 1.0137).alias("trees")
    )


QUERIES["r68_percentile_band"] = lambda s, d: B.percentile_band(_tree_standin(s, d)).drop("trees")
ORACLES["r68_percentile_band"] = f"""WITH l AS (SELECT l_orderkey, l_extendedprice * CAST(1.0137 AS DOUBLE) AS x FROM lineitem),
t AS (SELECT l_orderkey, avg(x) AS m, quantile_cont(x, 0.04) AS lo, quantile_cont(x, 0.96) AS hi FROM l GROUP BY 1)
SELECT l_orderkey, CAST({rint('m')} AS BIGINT) AS value_rm, CAST({rint('least(greatest(0, lo), m)')} AS BIGINT) AS low_rm,
  CAST({rint('greatest(hi, m)')} AS BIGINT) AS high_rm, CAST(0.92 AS DOUBLE) AS confidence FROM t"""
QUERIES["r70_calibrated_band"] = lambda s, d: B.calibrated_band(
    _tree_standin(s, d).withColumn("trees", F.transform("trees", F.log1p))
).drop("trees")
ORACLES["r70_calibrated_band"] = f"""WITH l AS (SELECT l_orderkey, l_extendedprice * CAST(1.0137 AS DOUBLE) AS x FROM lineitem),
t AS (SELECT l_orderkey, median(x) AS v, stddev_pop(x) * CAST(1.6737 AS DOUBLE) AS w FROM l GROUP BY 1)
SELECT l_orderkey, CAST({rint('v')} AS BIGINT) AS value_rm, CAST({rint('greatest(0, v - w)')} AS BIGINT) AS low_rm,
  CAST({rint('v + w')} AS BIGINT) AS high_rm, {r_even('least(greatest(1 - w / greatest(v, 1), 0), 1)', 3)} AS confidence FROM t"""

def _held_standin(s: SparkSession, d: str) -> DataFrame:
    """Line prices of an order as its trees, its total as the price, five folds."""
    orders = frame(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice", (F.col("o_orderkey") % 5).cast("int").alias("fold"))
    trees = _tree_standin(s, d).withColumn("trees", F.transform("trees", F.log1p))
    return trees.join(orders, "l_orderkey")


QUERIES["r70_conformal_folds"] = lambda s, d: share_rounded(
    B.conformal_coverage(_held_standin(s, d), "o_totalprice", "fold"), ["k", "coverage"], 5
)
ORACLES["r70_conformal_folds"] = f"""WITH l AS (SELECT l_orderkey, l_extendedprice * CAST(1.0137 AS DOUBLE) AS x FROM lineitem),
t AS (SELECT l_orderkey, median(x) AS v, stddev_pop(x) AS sd, count(*) AS trees FROM l GROUP BY 1),
m AS (SELECT CAST(o_orderkey % 5 AS INTEGER) AS fold, CASE WHEN trees > 1 THEN abs(o_totalprice - v) / sd ELSE CAST('inf' AS DOUBLE) END AS miss
  FROM t JOIN orders ON o_orderkey = l_orderkey),
f AS (SELECT DISTINCT fold FROM m),
k AS (SELECT f.fold, quantile_cont(m.miss, 0.8) AS k FROM f JOIN m ON m.fold <> f.fold GROUP BY 1)
SELECT m.fold, count(*) AS n, {r_even('max(k)', 5)} AS k, {r_even('avg(CASE WHEN miss <= k THEN 1.0 ELSE 0.0 END)', 5)} AS coverage
FROM m JOIN k ON k.fold = m.fold GROUP BY 1"""


# --- a forest as a table of nodes ------------------------------------------------------------

# eight trees of three levels: thresholds and leaf values are means over all lines, so both sides walk one table
SQL["forest_node"] = """SELECT CAST(l.l_suppkey % 8 AS INT) AS tree, CAST(l.l_linenumber - 1 AS INT) AS node, CAST((l.l_linenumber - 1) % 3 AS INT) AS feature,
  CASE (l.l_linenumber - 1) % 3 WHEN 0 THEN CAST(sum(CAST(floor(l.l_quantity) AS BIGINT)) AS DOUBLE) / count(*) + l.l_suppkey % 8
    WHEN 1 THEN CAST(sum(l.l_partkey % 90) AS DOUBLE) / count(*) ELSE CAST(sum(l.l_orderkey % 7) AS DOUBLE) / count(*) END AS threshold,
  CAST(2 * l.l_linenumber - 1 AS INT) AS left_node, CAST(2 * l.l_linenumber AS INT) AS right_node, CAST(NULL AS DOUBLE) AS value
FROM {lineitem} l GROUP BY l.l_suppkey % 8, l.l_linenumber
UNION ALL SELECT CAST(l.l_suppkey % 8 AS INT), CAST(7 + l.l_orderkey % 8 AS INT), CAST(NULL AS INT), CAST(NULL AS DOUBLE), CAST(NULL AS INT), CAST(NULL AS INT),
  CAST(sum(CAST(floor(l.l_extendedprice) AS BIGINT)) AS DOUBLE) / count(*) FROM {lineitem} l GROUP BY l.l_suppkey % 8, l.l_orderkey % 8"""
WALKED = ("CAST(age + step AS DOUBLE)", "mileage / CAST(4000 AS DOUBLE)", "CAST(services_done % 7 AS DOUBLE)")


def _walked(s: SparkSession, d: str, years: int) -> DataFrame:
    """profile_id, year, step, tree and value: stand-in profiles down a stand-in forest, by node joins."""
    nodes = frame(s, d, "forest_node").select(
        "tree", "node", "feature", "threshold", F.lit(None).cast("array<double>").alias("go_left"),
        F.col("left_node").alias("left"), F.col("right_node").alias("right"), "value",
    )
    steps = frame(s, d, "profile").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(years))))
    rows = steps.select("profile_id", "year", "step", F.array(*[F.expr(x) for x in WALKED]).alias("features"))
    return FO.walk(rows, S.materialise(nodes, "nodes"), ["profile_id", "year", "step"])


def _walk_sql(years: int) -> str:
    x = ", ".join(f"{e} AS x{i}" for i, e in enumerate(WALKED))
    return f"""{ctes('profile', 'forest_node').replace('WITH ', 'WITH RECURSIVE ', 1)},
xs AS (SELECT profile_id, year, CAST(step AS INTEGER) AS step, {x} FROM profile, range({years + 1}) t(step)),
w(profile_id, year, step, x0, x1, x2, tree, spot) AS (
  SELECT xs.*, t.tree, 0 FROM xs, (SELECT DISTINCT tree FROM forest_node) t
  UNION ALL SELECT profile_id, year, step, x0, x1, x2, w.tree, CASE WHEN CASE n.feature WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END <= n.threshold THEN left_node ELSE right_node END
  FROM w JOIN forest_node n ON n.tree = w.tree AND n.node = w.spot AND n.feature IS NOT NULL),
v AS (SELECT profile_id, year, step, w.tree, n.value FROM w JOIN forest_node n ON n.tree = w.tree AND n.node = w.spot AND n.feature IS NULL)"""


QUERIES["r67_node_walk"] = lambda s, d: _walked(s, d, 0).select("profile_id", "tree", round_even("value", 5).alias("value"))
ORACLES["r67_node_walk"] = f"{_walk_sql(0)} SELECT profile_id, tree, {r_even('value', 5)} AS value FROM v"
QUERIES["r68_node_band"] = lambda s, d: B.percentile_band(FO.gather(_walked(s, d, 0), ["profile_id"])).select(
    "profile_id", "value_rm", "low_rm", "high_rm", "confidence"
)
ORACLES["r68_node_band"] = f"""{_walk_sql(0)}, t AS (SELECT profile_id, avg(value) AS m, quantile_cont(value, 0.04) AS lo, quantile_cont(value, 0.96) AS hi FROM v GROUP BY 1)
SELECT profile_id, CAST({rint('m')} AS BIGINT) AS value_rm, CAST({rint('least(greatest(0, lo), m)')} AS BIGINT) AS low_rm,
  CAST({rint('greatest(hi, m)')} AS BIGINT) AS high_rm, CAST(0.92 AS DOUBLE) AS confidence FROM t"""
QUERIES["r59_node_curve"] = lambda s, d: C.model_curve(
    FO.gather(_walked(s, d, 5), ["profile_id", "year", "step"]).withColumn("prediction", B.array_mean("trees"))
)
ORACLES["r59_node_curve"] = f"""{_walk_sql(5)}, p AS (SELECT profile_id, year, step, avg(value) AS p FROM v GROUP BY ALL),
m AS (SELECT *, min(greatest(p, 0)) OVER (PARTITION BY profile_id ORDER BY step) AS low FROM p),
f AS (SELECT *, first_value(low) OVER (PARTITION BY profile_id ORDER BY step) AS today FROM m)
SELECT profile_id, step, CAST(year + step AS INTEGER) AS year, CAST({rint('low')} AS BIGINT) AS value_rm,
  {r_even('low / CASE WHEN today > 0 THEN today ELSE 1 END', 4)} AS retained_pct FROM f"""

# --- fits (rows only) ------------------------------------------------------------------------


def _forest_predictions(s: SparkSession, d: str) -> DataFrame:
    train, model = _fitted(s, d)
    return model.transform(train).select("row_key", "part_key", "supp_key", TARGET, "prediction")


def _ridge_predictions(s: SparkSession, d: str) -> DataFrame:
    train = training_frame(s, d)
    model = ML.fit(train, ML.ridge(train))
    return model.transform(train).select("row_key", "part_key", "supp_key", TARGET, "prediction")


def _tree_values(s: SparkSession, d: str) -> DataFrame:
    train, model = _fitted(s, d)
    table = ML.save_and_table(model, s, S.shared_dir(s, "forest"))
    return ML.with_tree_values(model.transform(train), table, ["row_key", "part_key", "supp_key"])


QUERIES["r61_preprocess"] = lambda s, d: (
    lambda t: ML.Pipeline(stages=ML.preprocessor()).fit(t).transform(t).select(
        "row_key", F.size(ML.vector_to_array("features")).alias("n_features"),
        round_even(F.aggregate(ML.vector_to_array("features"), F.lit(0.0), lambda a, x: a + x), 6).alias("checksum"),
    )
)(training_frame(s, d))
QUERIES["r62_forest"] = _forest_predictions
QUERIES["r63_ridge"] = _ridge_predictions
QUERIES["r65_cross_validation"] = lambda s, d: ML.cross_validate(training_frame(s, d), folds=5, trees=4, depth=4)[1]
QUERIES["r67_tree_predictions"] = lambda s, d: ML.tree_predictions(_tree_values(s, d), "row_key")
QUERIES["r68_forest_band"] = lambda s, d: B.percentile_band(_tree_values(s, d)).select(
    "row_key", TARGET, "value_rm", "low_rm", "high_rm", "confidence"
)
def _log_band(s: SparkSession, d: str) -> DataFrame:
    """Forest of log prices on all rows, its band calibrated out of fold."""
    key = ["row_key", "part_key", "supp_key"]
    train = training_frame(s, d).withColumn(ML.LOG_TARGET, F.log1p(TARGET))
    held = ML.out_of_fold(train, S.shared_dir(s, "log-folds"), folds=3, trees=TREES, depth=DEPTH, min_leaf=10, key=key, label=ML.LOG_TARGET)
    model = ML.fit(train, ML.forest(label=ML.LOG_TARGET, trees=TREES, depth=DEPTH, min_leaf=10))
    valued = ML.with_tree_values(model.transform(train), ML.save_and_table(model, s, S.shared_dir(s, "log-forest")), key)
    return B.calibrated_band(valued, k=B.conformal_scale(held, TARGET).first()["k"]).select(*key, TARGET, "value_rm", "low_rm", "high_rm", "confidence")


QUERIES["r70_log_band"] = _log_band
QUERIES["r69_band_coverage"] = lambda s, d: ML.band_coverage(
    training_frame(s, d), S.shared_dir(s, "coverage"), folds=5, trees=TREES, depth=4
)
QUERIES["r75_feature_importance"] = lambda s, d: (lambda tm: ML.feature_importance(tm[1], tm[0]))(_fitted(s, d))
QUERIES["r76_permutation_importance"] = lambda s, d: (
    lambda tm: ML.permutation_importance(tm[1], tm[0], ["row_key", "part_key", "supp_key"], CATEGORICAL_FEATURES + NUMERIC_FEATURES)
)(_fitted(s, d))
QUERIES["r77_ablation"] = lambda s, d: ML.ablation(
    training_frame(s, d), ["row_key", "part_key", "supp_key"], SIMULATED_FEATURES, CATEGORICAL_FEATURES,
    [c for c in NUMERIC_FEATURES if c not in SIMULATED_FEATURES], folds=5, trees=3, depth=4,
)

# --- sinks -----------------------------------------------------------------------------------


def _csv_round_trip(s: SparkSession, d: str, name: str, reader) -> DataFrame:
    path = S.shared_dir(s, name)
    S.write_table(frame(s, d, name), path, form="csv")
    return reader(s, path)


QUERIES["r01_scan_uk"] = lambda s, d: _csv_round_trip(s, d, "uk_raw", S.read_uk)
ORACLES["r01_scan_uk"] = f"{ctes('uk_raw')} SELECT * FROM uk_raw"
QUERIES["r01_scan_germany"] = lambda s, d: _csv_round_trip(s, d, "germany_raw", S.read_germany)
ORACLES["r01_scan_germany"] = f"""{ctes('germany_raw')} SELECT * REPLACE (nullif(year, '') AS year) FROM germany_raw"""
QUERIES["r01_scan_us"] = lambda s, d: _csv_round_trip(s, d, "us_raw", S.read_us)
ORACLES["r01_scan_us"] = f"{ctes('us_raw')} SELECT * FROM us_raw"
QUERIES["r02_scan_specs"] = lambda s, d: _csv_round_trip(s, d, "spec_raw", S.read_specs).drop("spec_pos")
ORACLES["r02_scan_specs"] = f"{ctes('spec_raw')} SELECT * EXCLUDE (spec_pos) FROM spec_raw"
QUERIES["r03_scan_pages"] = lambda s, d: S.read_pages(s, f"{d}/pages.parquet")
ORACLES["r03_scan_pages"] = "SELECT * FROM pages"


def _table_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = S.shared_dir(s, "processed")
    df = frame(s, d, "listing").select("row_key", "part_key", "supp_key", "model_class", "price_rm", "source_market")
    S.write_table(df, path, partition_by=["source_market"])
    S.write_table(df.filter("model_class is not null"), path, partition_by=["source_market"])
    return s.read.parquet(path)


QUERIES["r04_table_sink"] = _table_round_trip
ORACLES["r04_table_sink"] = f"""{ctes('listing')} SELECT row_key, part_key, supp_key, model_class, price_rm, source_market FROM listing WHERE model_class IS NOT NULL"""

QUERIES["r05_market_features"] = lambda s, d: S.market_features(frame(s, d, "market_listing"), 2026)
ORACLES["r05_market_features"] = f"""{ctes('market_listing')} SELECT source, listing_url, model, year, CAST(2026 - year AS INTEGER) AS age, mileage, price_rm,
  transmission, fuel_type, CAST(NULL AS DOUBLE) AS engine_size, variant, location, seller_type, posted_at, scraped_at FROM market_listing"""
_SHAPE_KNOWN = {
    "specific model of the car": "concat_ws(' ', model, nullif(variant, ''))", "gear type/transmission": "transmission",
    "mileage": "mileage", "fuel type": "fuel_type", "year of the car": "year", "price (RM)": "price_rm",
}
QUERIES["r06_spec_shape"] = lambda s, d: S.spec_shape(frame(s, d, "market_listing"))
ORACLES["r06_spec_shape"] = f"{ctes('market_listing')} SELECT " + ", ".join(
    f'{_SHAPE_KNOWN.get(c, "CAST(NULL AS VARCHAR)")} AS "{c}"' for c in S.SPEC_SHAPE_COLUMNS
) + " FROM market_listing"
QUERIES["r06_spec_shape_compact"] = lambda s, d: S.spec_shape(frame(s, d, "market_listing"), compact=True)
ORACLES["r06_spec_shape_compact"] = f"{ctes('market_listing')} SELECT " + ", ".join(
    f'{_SHAPE_KNOWN.get(c, c)} AS "{c}"' for c in S.COMPACT_COLUMNS
) + " FROM market_listing"
QUERIES["r06_spec_shape_summary"] = lambda s, d: S.spec_shape_summary(S.spec_shape(frame(s, d, "market_listing")))
ORACLES["r06_spec_shape_summary"] = f"""{ctes('market_listing')} SELECT count(*) AS rows, count(*) AS missing_technical_specs,
  count(*) - count(transmission) AS missing_transmission, count(*) - count(fuel_type) AS missing_fuel_type, count(*) - count(mileage) AS missing_mileage FROM market_listing"""


def _append(s: SparkSession, d: str) -> DataFrame:
    """Two overlapping runs into one table."""
    path = S.shared_dir(s, "append")
    rows = frame(s, d, "orders").select(
        F.concat(F.lit("https://specs.example/"), F.col("o_custkey")).alias("source_url"), F.col("o_orderkey").alias("first_order")
    )
    S.append_with_resume(rows.filter("o_orderkey % 2 = 0"), path)
    S.append_with_resume(rows, path)
    return s.read.parquet(path)


QUERIES["r07_append_resume"] = _append
ORACLES["r07_append_resume"] = """WITH a AS (SELECT o_custkey AS c, min(o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
b AS (SELECT o_custkey AS c, min(o_orderkey) AS k FROM orders WHERE o_custkey NOT IN (SELECT c FROM a) GROUP BY 1)
SELECT 'https://specs.example/' || CAST(c AS VARCHAR) AS source_url, k AS first_order FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"""

QUERIES["r08_training_load"] = lambda s, d: S.reload_training(frame(s, d, "uk_raw"), S.shared_dir(s, "load"), 2026, 5.90)
_LABEL = class_label("model")
ORACLES["r08_training_load"] = f"""{ctes('uk_raw')}, t AS (SELECT *, {_LABEL} AS label, TRY_CAST(price AS DOUBLE) AS p, CAST(year AS INTEGER) AS y,
  regexp_matches(trim(model), '^\\d+$') AS numeric_only FROM uk_raw),
r AS (SELECT *, CASE WHEN numeric_only THEN 'n' WHEN coalesce(y BETWEEN 1970 AND 2026 AND p > 0 AND label IS NOT NULL, false) THEN 'k' ELSE 's' END AS reason,
  CAST({rint('p * CAST(5.90 AS DOUBLE)')} AS BIGINT) AS price_rm FROM t)
SELECT count(*) AS rows_in, count(*) FILTER (WHERE reason = 'n') AS rows_dropped_numeric_only, count(*) FILTER (WHERE reason = 's') AS rows_dropped_sanity_filter,
  count(*) FILTER (WHERE reason = 'k') AS rows_written, min(price_rm) FILTER (WHERE reason = 'k') AS price_rm_min, max(price_rm) FILTER (WHERE reason = 'k') AS price_rm_max FROM r"""


def _saved_report(s: SparkSession, d: str) -> DataFrame:
    """Save a fitted pipeline and its report, and read the report back."""
    train, model = _fitted(s, d)
    scored = model.transform(train)
    metrics = MT.regression_metrics(scored, TARGET, "prediction")
    coverage = MT.interval_coverage(scored.withColumn("hi", F.col("prediction") * 1.5), TARGET, "prediction", "hi")
    path = S.shared_dir(s, "artifact")
    S.save_model(model, S.model_report(metrics, coverage, train, {"trees": TREES, "depth": DEPTH}), path, s)
    saved = s.read.text(f"{path}/report")
    return saved.select(
        F.get_json_object("value", "$.n_rows").cast("bigint").alias("n_rows"),
        F.get_json_object("value", "$.source_markets.uk").cast("bigint").alias("uk"),
        F.get_json_object("value", "$.source_markets.germany").cast("bigint").alias("germany"),
        F.get_json_object("value", "$.fx_rates.gbp_to_rm").cast("double").alias("gbp_to_rm"),
    )


QUERIES["r09_model_sink"] = _saved_report
ORACLES["r09_model_sink"] = f"""{ctes('listing')} SELECT count(*) AS n_rows, count(*) FILTER (WHERE source_market = 'uk') AS uk,
  count(*) FILTER (WHERE source_market = 'germany') AS germany, CAST(5.9 AS DOUBLE) AS gbp_to_rm FROM listing"""
