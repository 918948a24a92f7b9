"""Queries: profiling and statistics (R78-R93)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motoquant.config import LISTING_KEY
from motoquant.functions.numeric import round_even
from motoquant.operators import profile as P
from motoquant.operators.features import share_rounded
from motoquant.plans.queries_core import NEAREST_CTES, enriched
from motoquant.plans.sqltext import r_even, uniform
from motoquant.plans.standins import ctes, frame

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

NUM = ["mileage", "price_rm", "engine_size", "displacement_cc", "torque_nm", "boot_l"]
CAT = ["model_class", "fuel_type", "transmission", "aspiration", "match_level"]
E = NEAREST_CTES


def _each(columns: list[str], body) -> str:
    return " UNION ALL ".join(body(c) for c in columns)


def _q(c: str, p: float, digits: int = 4) -> str:
    return r_even(f"quantile_cont(CAST({c} AS DOUBLE), {p})", digits)


QUERIES["r78_numeric_summary"] = lambda s, d: share_rounded(
    P.numeric_summary(enriched(s, d), NUM), ["mean", "std", "min", "q25", "q50", "q75", "max"], 3
)
ORACLES["r78_numeric_summary"] = E + _each(NUM, lambda c: f"""
SELECT '{c}' AS "column", count({c}) AS count, {r_even(f'avg({c})', 3)} AS mean, {r_even(f'stddev_samp({c})', 3)} AS std,
  {r_even(f'min({c})', 3)} AS min, {_q(c, .25, 3)} AS q25, {_q(c, .5, 3)} AS q50, {_q(c, .75, 3)} AS q75, {r_even(f'max({c})', 3)} AS max FROM enriched""")

QUERIES["r78_text_summary"] = lambda s, d: P.text_summary(enriched(s, d), CAT + ["variant"])
ORACLES["r78_text_summary"] = E + _each(CAT + ["variant"], lambda c: f"""
SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
  first({c} ORDER BY n DESC, {c}) AS top, max(n) AS freq
FROM (SELECT {c}, count(*) AS n FROM enriched WHERE {c} IS NOT NULL GROUP BY 1)""")

QUERIES["r79_shape"] = lambda s, d: share_rounded(
    P.shape_table(enriched(s, d), ["mileage", "price_rm", "displacement_cc"]),
    ["skew", "kurtosis", "log_skew", "p01", "p05", "p25", "p50", "p75", "p95", "p99"], 4,
).drop("n")


def _moment(c: str) -> str:
    m = lambda k: f"avg(pow(x - mu, {k}))"
    lm = lambda k: f"avg(pow(ln(1 + x) - lmu, {k}))"
    return f"""SELECT '{c}' AS "column", {r_even(f'{m(3)} / pow({m(2)}, CAST(1.5 AS DOUBLE))', 4)} AS skew,
  {r_even(f'{m(4)} / pow({m(2)}, 2) - 3', 4)} AS kurtosis, {r_even(f'{lm(3)} / pow({lm(2)}, CAST(1.5 AS DOUBLE))', 4)} AS log_skew,
  {_q('x', .01)} AS p01, {_q('x', .05)} AS p05, {_q('x', .25)} AS p25, {_q('x', .5)} AS p50, {_q('x', .75)} AS p75,
  {_q('x', .95)} AS p95, {_q('x', .99)} AS p99
FROM (SELECT CAST({c} AS DOUBLE) AS x, (SELECT avg({c}) FROM enriched) AS mu, (SELECT avg(ln(1 + {c})) FROM enriched) AS lmu
  FROM enriched WHERE {c} IS NOT NULL)"""


ORACLES["r79_shape"] = E + " " + _each(["mileage", "price_rm", "displacement_cc"], _moment)

LENSES = {
    "listing_key": LISTING_KEY,
    "class_year_km": ["model_class", "year", "mileage"],
    "row": ["row_key", "part_key", "supp_key"],
}
QUERIES["r80_duplicate_lens"] = lambda s, d: (lambda e: P.duplicate_lens(e, {"exact": e.columns, **LENSES}))(enriched(s, d))
ORACLES["r80_duplicate_lens"] = E + _each(["exact", *LENSES], lambda n: f"""
SELECT '{n}' AS lens, CAST(coalesce(sum(c), 0) AS BIGINT) AS duplicate_rows, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS extra_rows
FROM (SELECT count(*) AS c FROM enriched GROUP BY {', '.join(LENSES.get(n, ['row_key', 'part_key', 'supp_key', 'model_class', 'year', 'mileage', 'price_rm', 'fuel_type', 'transmission', 'engine_size']))} HAVING count(*) > 1)""")
QUERIES["r80_duplicate_rows"] = lambda s, d: P.duplicate_rows(
    frame(s, d, "listing"), ["model_class", "year", "mileage"]
).select("row_key", "part_key", "supp_key", "model_class", "copies")
ORACLES["r80_duplicate_rows"] = f"""{ctes('listing')} SELECT row_key, part_key, supp_key, model_class, copies FROM
(SELECT *, count(*) OVER (PARTITION BY model_class, year, mileage) AS copies FROM listing) WHERE copies > 1"""

GAPS = ["model_class", "engine_size", "variant", *["displacement_cc", "n_gears", "torque_nm", "boot_l"], "price_rm"]
QUERIES["r81_missing_by_column"] = lambda s, d: P.missing_by_column(enriched(s, d).select(*GAPS))
ORACLES["r81_missing_by_column"] = E + " SELECT * FROM (" + _each(GAPS, lambda c: f"""
SELECT '{c}' AS "column", count(*) - count({c}) AS missing, {r_even(f'(count(*) - count({c})) * 100 / CAST(count(*) AS DOUBLE)', 2)} AS pct FROM enriched""") + ") WHERE missing > 0"

_MISS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in GAPS)
QUERIES["r82_usable_rows"] = lambda s, d: P.usable_rows(enriched(s, d).select(*GAPS))
ORACLES["r82_usable_rows"] = f"""{E}, m AS (SELECT {_MISS} AS k FROM enriched),
ks AS (SELECT CAST(i AS INTEGER) AS i FROM range((SELECT max(k) FROM m) + 1) t(i))
SELECT i AS max_missing_per_row, (SELECT count(*) FROM m WHERE k <= i) AS usable_rows,
  {r_even('(SELECT count(*) FROM m WHERE k <= i) * 100 / CAST((SELECT count(*) FROM m) AS DOUBLE)', 1)} AS pct FROM ks"""
QUERIES["r82_sparse_rows"] = lambda s, d: P.sparse_rows(enriched(s, d).select(*GAPS))
ORACLES["r82_sparse_rows"] = f"""{E}, m AS (SELECT ({_MISS}) * 100.0 / {len(GAPS)} AS k FROM enriched)
SELECT CAST(t AS INTEGER) AS threshold_pct, (SELECT count(*) FROM m WHERE k > t) AS rows_above,
  {r_even('(SELECT count(*) FROM m WHERE k > t) * 100 / CAST((SELECT count(*) FROM m) AS DOUBLE)', 1)} AS pct
FROM (VALUES (30), (50), (70)) v(t)"""

QUERIES["r83_impute"] = lambda s, d: P.impute(
    enriched(s, d).select("row_key", "part_key", "supp_key", "model_class", "boot_l", "torque_nm"),
    ["boot_l", "torque_nm"], ["model_class"],
)
ORACLES["r83_impute"] = f"""{E} SELECT row_key, part_key, supp_key,
  coalesce(model_class, (SELECT first(model_class ORDER BY n DESC, model_class) FROM
    (SELECT model_class, count(*) AS n FROM enriched WHERE model_class IS NOT NULL GROUP BY 1))) AS model_class,
  coalesce(boot_l, (SELECT median(boot_l) FROM enriched)) AS boot_l,
  coalesce(torque_nm, (SELECT median(torque_nm) FROM enriched)) AS torque_nm FROM enriched"""
QUERIES["r83_imputation_effect"] = lambda s, d: share_rounded(
    P.imputation_effect(enriched(s, d), ["boot_l"], []).drop("column"), ["mean", "std", "q25", "q50", "q75"], 3
)
ORACLES["r83_imputation_effect"] = f"""{E}, f AS (SELECT 'before' AS stage, boot_l AS x FROM enriched
  UNION ALL SELECT 'after', coalesce(boot_l, (SELECT median(boot_l) FROM enriched)) FROM enriched)
SELECT stage, count(x) AS count, {r_even('avg(x)', 3)} AS mean, {r_even('stddev_samp(x)', 3)} AS std, min(x) AS min,
  {_q('x', .25, 3)} AS q25, {_q('x', .5, 3)} AS q50, {_q('x', .75, 3)} AS q75, max(x) AS max FROM f GROUP BY 1"""

QUERIES["r84_iqr_outliers"] = lambda s, d: P.iqr_outliers(enriched(s, d), ["price_rm", "mileage", "torque_nm"])
ORACLES["r84_iqr_outliers"] = E + _each(["price_rm", "mileage", "torque_nm"], lambda c: f"""
SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outliers, {r_even('max(lo)', 1)} AS low, {r_even('max(hi)', 1)} AS high
FROM enriched, (SELECT q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS lo, q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS hi FROM
  (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM enriched))""")
QUERIES["r84_quality_checks"] = lambda s, d: P.quality_checks(
    enriched(s, d),
    {"torque_nm broken": F.col("torque_nm") > 2000, "engine_size low": F.col("engine_size") < 0.5},
    ["spec_matched", "source_market"],
)
ORACLES["r84_quality_checks"] = f"""{E}
SELECT 'torque_nm broken' AS "check", count(*) FILTER (WHERE torque_nm > 2000) AS count_or_flag FROM enriched
UNION ALL SELECT 'engine_size low', count(*) FILTER (WHERE engine_size < 0.5) FROM enriched
UNION ALL SELECT 'spec_matched constant', CAST(count(DISTINCT spec_matched) = 1 AS BIGINT) FROM enriched
UNION ALL SELECT 'source_market constant', CAST(count(DISTINCT source_market) = 1 AS BIGINT) FROM enriched"""

QUERIES["r85_value_counts"] = lambda s, d: P.value_counts(enriched(s, d), CAT + ["variant"])
ORACLES["r85_value_counts"] = E + _each(CAT + ["variant"], lambda c: f"""
SELECT * FROM (SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY n DESC, value NULLS FIRST) AS INTEGER) AS rank, value, n,
  count(value) OVER () AS n_unique FROM (SELECT {c} AS value, count(*) AS n FROM enriched GROUP BY 1)) WHERE rank <= 8""")

QUERIES["r86_histogram"] = lambda s, d: share_rounded(
    P.histogram(frame(s, d, "listing"), "price_rm", 60), ["bin_low", "bin_high"], 4
)
ORACLES["r86_histogram"] = f"""{ctes('listing')}, r AS (SELECT CAST(min(price_rm) AS DOUBLE) AS lo, CAST(max(price_rm) AS DOUBLE) AS hi FROM listing),
b AS (SELECT CAST(least(floor((price_rm - lo) * 60 / (hi - lo)), 59) AS INTEGER) AS bin, count(*) AS n FROM listing, r GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, {r_even('lo + i * ((hi - lo) / 60)', 4)} AS bin_low, {r_even('lo + (i + 1) * ((hi - lo) / 60)', 4)} AS bin_high,
  coalesce(n, 0) AS n FROM range(60) t(i) CROSS JOIN r LEFT JOIN b ON b.bin = i"""

QUERIES["r87_correlations"] = lambda s, d: share_rounded(P.correlations(enriched(s, d), NUM), ["r"], 6)
ORACLES["r87_correlations"] = E + " UNION ALL ".join(
    f" SELECT '{a}' AS column_a, '{b}' AS column_b, {r_even(f'corr({a}, {b})', 6)} AS r FROM enriched"
    for i, a in enumerate(NUM) for b in NUM[i + 1:]
)
QUERIES["r87_target_correlations"] = lambda s, d: share_rounded(
    P.target_correlations(enriched(s, d), ["mileage", "age", "engine_size", "torque_nm"], "price_rm"), ["r", "r_log"], 6
)
ORACLES["r87_target_correlations"] = E + _each(["mileage", "age", "engine_size", "torque_nm"], lambda c: f"""
SELECT '{c}' AS "column", {r_even(f'corr({c}, price_rm)', 6)} AS r, {r_even(f'corr({c}, ln(1 + price_rm))', 6)} AS r_log FROM enriched""")

STRONG = ["age", "year", "mileage", "displacement_cc", "torque_nm", "n_gears", "top_speed_kmh", "boot_l"]
QUERIES["r88_strong_pairs"] = lambda s, d: share_rounded(P.strong_pairs(enriched(s, d), STRONG), ["r"], 6)
ORACLES["r88_strong_pairs"] = E + " SELECT column_a, column_b, " + r_even("r", 6) + " AS r FROM (" + " UNION ALL ".join(
    f" SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM enriched"
    for i, a in enumerate(STRONG) for b in STRONG[i + 1:]
) + ") WHERE abs(r) > 0.8"

QUERIES["r89_correlation_ratio"] = lambda s, d: share_rounded(
    P.correlation_ratio(enriched(s, d), CAT, "price_rm"), ["eta"], 6
)
ORACLES["r89_correlation_ratio"] = E + _each(CAT, lambda c: f"""
SELECT '{c}' AS "column", {r_even('sqrt(sum(n * pow(m - mu, 2)) / max(sst))', 6)} AS eta FROM
(SELECT {c}, count(*) AS n, avg(price_rm) AS m FROM enriched WHERE {c} IS NOT NULL GROUP BY 1),
(SELECT avg(price_rm) AS mu, var_pop(price_rm) * count(*) AS sst FROM enriched)""")

QUERIES["r90_group_boxes"] = lambda s, d: share_rounded(
    P.group_boxes(enriched(s, d), "model_class", "price_rm"), ["q1", "median", "q3", "mean"], 3
)
ORACLES["r90_group_boxes"] = f"""{E} SELECT model_class, count(price_rm) AS n, {r_even('avg(price_rm)', 3)} AS mean,
  CAST(min(price_rm) AS DOUBLE) AS min, CAST(max(price_rm) AS DOUBLE) AS max, {_q('price_rm', .25, 3)} AS q1,
  {_q('price_rm', .5, 3)} AS median, {_q('price_rm', .75, 3)} AS q3 FROM enriched GROUP BY 1"""

VIF = ["age", "mileage", "displacement_cc"]
QUERIES["r91_variance_inflation"] = lambda s, d: share_rounded(P.variance_inflation(enriched(s, d), VIF), ["vif"], 4)


def _vif_sql() -> str:
    """Closed form of the inverse of a 3 by 3 matrix."""
    p = lambda a, b: f"sum({a} * {b})"
    a, b, c = VIF
    return f"""{E}, g AS (SELECT {p(a, a)} AS aa, {p(a, b)} AS ab, {p(a, c)} AS ac, {p(b, b)} AS bb, {p(b, c)} AS bc, {p(c, c)} AS cc
  FROM (SELECT CAST({a} AS DOUBLE) AS {a}, CAST({b} AS DOUBLE) AS {b}, CAST({c} AS DOUBLE) AS {c} FROM enriched
        WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND {c} IS NOT NULL)),
n AS (SELECT ab / sqrt(aa * bb) AS x, ac / sqrt(aa * cc) AS y, bc / sqrt(bb * cc) AS z FROM g),
dt AS (SELECT *, 1 + 2 * x * y * z - x * x - y * y - z * z AS det FROM n)
SELECT '{a}' AS "column", {r_even('(1 - z * z) / det', 4)} AS vif FROM dt
UNION ALL SELECT '{b}', {r_even('(1 - y * y) / det', 4)} FROM dt
UNION ALL SELECT '{c}', {r_even('(1 - x * x) / det', 4)} FROM dt"""


ORACLES["r91_variance_inflation"] = _vif_sql()

QUERIES["r92_frequency_encode"] = lambda s, d: P.frequency_encode(enriched(s, d), "variant", "variant_freq").select(
    "row_key", "part_key", "supp_key", "variant", "variant_freq"
)
ORACLES["r92_frequency_encode"] = f"""{E} SELECT row_key, part_key, supp_key, variant,
  CASE WHEN variant IS NOT NULL THEN count(*) OVER (PARTITION BY variant) END AS variant_freq FROM enriched"""

QUERIES["r93_holdout"] = lambda s, d: P.holdout_flag(frame(s, d, "listing"), ["row_key"]).select(
    "row_key", "part_key", "supp_key", "is_test"
)
ORACLES["r93_holdout"] = f"""{ctes('listing')} SELECT row_key, part_key, supp_key, {uniform('row_key', 'holdout')} < CAST(0.2 AS DOUBLE) AS is_test FROM listing"""
