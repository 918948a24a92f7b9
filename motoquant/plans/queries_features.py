"""Queries: health features (R51-R57) and scoring-time enrichment (R71)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motoquant.functions import health as H
from motoquant.functions import noise as N
from motoquant.functions.numeric import round_even
from motoquant.operators import features as FT
from motoquant.plans.queries_core import NEAREST_CTES, enriched
from motoquant.plans.sqltext import canonical_class, gaussian, r_even, uniform
from motoquant.plans.standins import ctes, frame

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

L = ctes("listing")
KEYS = "row_key, part_key, supp_key"


def clip_sql(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, CAST({low} AS DOUBLE)), CAST({high} AS DOUBLE))"


def soh_sql(noise: str = "0") -> str:
    base = """(CASE WHEN fuel_type = 'Hybrid'
      THEN 100 * exp(CAST(-0.35 AS DOUBLE) * pow(mileage / 100000, CAST(1.6 AS DOUBLE))) - CAST(0.4 AS DOUBLE) * age
      ELSE 100 * exp(CAST(-0.045 AS DOUBLE) * age) - CAST(0.8 AS DOUBLE) * (mileage / 100000) END)"""
    return r_even(clip_sql(f"{base} + {noise}", 30, 100), 2)


def offset_sql(noise: str = "0") -> str:
    worn = f"""(CASE WHEN mileage < 60000 THEN CAST(-0.02 AS DOUBLE) WHEN mileage < 120000 THEN CAST(-0.05 AS DOUBLE)
      ELSE CAST(-0.1 AS DOUBLE) END + CAST(-0.02 AS DOUBLE) * (mileage / 120000) + {noise})"""
    return f"CASE WHEN transmission = 'Manual' THEN CAST(0 AS DOUBLE) ELSE {r_even(f'least({worn}, CAST(-0.0001 AS DOUBLE))', 4)} END"


def wear_km(c: str) -> str:
    return f"CASE {c} WHEN 'Ventilated Discs' THEN 300000 WHEN 'Discs' THEN 220000 WHEN 'Drums' THEN 260000 ELSE 250000 END"


QUERIES["r51_battery_soh"] = lambda s, d: frame(s, d, "listing").select(
    "row_key", "part_key", "supp_key", "fuel_type", H.battery_soh("fuel_type", "age", "mileage").alias("battery_soh")
)
ORACLES["r51_battery_soh"] = f"{L} SELECT {KEYS}, fuel_type, {soh_sql()} AS battery_soh FROM listing"

QUERIES["r52_transmission_offset"] = lambda s, d: frame(s, d, "listing").select(
    "row_key", "part_key", "supp_key", H.transmission_offset("transmission", "mileage").alias("trans_adapt_offset")
)
ORACLES["r52_transmission_offset"] = f"{L} SELECT {KEYS}, {offset_sql()} AS trans_adapt_offset FROM listing"

QUERIES["r53_seeded_noise"] = lambda s, d: FT.engineer(frame(s, d, "listing"), ["row_key"]).select(
    "row_key", "part_key", "supp_key", "battery_soh", "trans_adapt_offset",
    round_even(N.uniform(["row_key"], "u", 42), 9).alias("u"),
    N.poisson(F.lit(2.5), ["row_key"], "p", 42).alias("poisson"),
)


def poisson_sql(lam: str, key: str, salt: str, terms: int = 60) -> str:
    """Number of distribution-function values that stay below the uniform draw."""
    return f"""(SELECT CAST(count(*) AS INTEGER) FROM (SELECT sum(exp(-({lam})) * pow({lam}, i) / gamma(i + 1)) OVER (ORDER BY i) AS cdf
      FROM range({terms}) t(i)) WHERE cdf < {uniform(key, salt)})"""


def poisson_list_sql(lam: str, key: str, salt: str, terms: int = 26) -> str:
    """The same count written as a sum of comparisons on cumulated terms."""
    cdf = "0"
    arms = []
    fact = 1.0
    for i in range(terms):
        fact = fact * i if i else 1.0
        cdf = f"{cdf} + pow({lam}, {i}) / CAST({fact!r} AS DOUBLE)"
        arms.append(f"CASE WHEN exp(-({lam})) * ({cdf}) < u THEN 1 ELSE 0 END")
    return f"CAST({' + '.join(arms)} AS INTEGER)"


ORACLES["r53_seeded_noise"] = f"""{L}, n AS (SELECT *, {uniform('row_key', 'p')} AS u FROM listing)
SELECT {KEYS}, {soh_sql(gaussian('row_key', 'soh', 2.0))} AS battery_soh,
  {offset_sql(gaussian('row_key', 'offset', 0.005))} AS trans_adapt_offset,
  {r_even(uniform('row_key', 'u'), 9)} AS u, {poisson_list_sql('CAST(2.5 AS DOUBLE)', 'row_key', 'p')} AS poisson FROM n"""

QUERIES["r54_annual_mileage"] = lambda s, d: frame(s, d, "listing").select(
    "row_key", "part_key", "supp_key", H.annual_mileage("mileage", "age").alias("estimated_annual_mileage")
)
ORACLES["r54_annual_mileage"] = f"{L} SELECT {KEYS}, {r_even('mileage / greatest(age, 1)', 1)} AS estimated_annual_mileage FROM listing"

LAM = "(CAST(0.02 AS DOUBLE) * age + CAST(0.8 AS DOUBLE) * (mileage / 100000))"
QUERIES["r55_fault_count"] = lambda s, d: frame(s, d, "listing").select(
    "row_key", "part_key", "supp_key", round_even(H.expected_faults("age", "mileage"), 6).alias("expected"),
    N.poisson(H.expected_faults("age", "mileage"), ["row_key"], "faults", 42).alias("dtc_fault_count"),
)
ORACLES["r55_fault_count"] = f"""{L}, n AS (SELECT *, {uniform('row_key', 'faults')} AS u FROM listing)
SELECT {KEYS}, {r_even(LAM, 6)} AS expected, {poisson_list_sql(LAM, 'row_key', 'faults')} AS dtc_fault_count FROM n"""

BRAKES = r_even(
    clip_sql(
        f"100 * exp(-mileage / CAST(least({wear_km('front_brake')}, {wear_km('rear_brake')}) AS DOUBLE)) + {gaussian('row_key', 'brakes', 2.0)}",
        5, 100,
    ), 1,
)
QUERIES["r56_brake_life"] = lambda s, d: FT.vehicle_health(
    FT.engineer(enriched(s, d)), ["row_key"]
).select("row_key", "part_key", "supp_key", "front_brake", "rear_brake", "brake_life_pct")
ORACLES["r56_brake_life"] = f"{NEAREST_CTES} SELECT {KEYS}, front_brake, rear_brake, {BRAKES} AS brake_life_pct FROM enriched"

WEAR = r_even(clip_sql("""100 - ((100 - battery_soh) * CAST(0.25 AS DOUBLE) + least(25, dtc_fault_count * 6)
  + least(greatest((mileage - 100000) / 20000, 0), 15) + (100 - brake_life_pct) * CAST(0.15 AS DOUBLE)
  + least(10, -trans_adapt_offset * 50))""", 0, 100), 1)
QUERIES["r57_health_score"] = lambda s, d: FT.vehicle_health(
    FT.engineer(enriched(s, d), ["row_key"]), ["row_key"]
).select("row_key", "part_key", "supp_key", "battery_soh", "dtc_fault_count", "brake_life_pct", "health_score")
ORACLES["r57_health_score"] = f"""{NEAREST_CTES}, n AS (SELECT *, {uniform('row_key', 'faults')} AS u FROM enriched),
h AS (SELECT *, {soh_sql(gaussian('row_key', 'soh', 2.0))} AS battery_soh, {offset_sql(gaussian('row_key', 'offset', 0.005))} AS trans_adapt_offset,
  {poisson_list_sql(LAM, 'row_key', 'faults')} AS dtc_fault_count, {BRAKES} AS brake_life_pct FROM n)
SELECT {KEYS}, battery_soh, dtc_fault_count, brake_life_pct, {WEAR} AS health_score FROM h"""


def _scored(s: SparkSession, d: str) -> DataFrame:
    return FT.score_ready(frame(s, d, "profile"), frame(s, d, "spec"))


QUERIES["r71_score_ready"] = lambda s, d: _scored(s, d).select(
    "profile_id", "model_class", "source_market", "engine_size", "variant", "torque_nm", "gear_type",
    "match_level", "battery_soh", "trans_adapt_offset",
)
ORACLES["r71_score_ready"] = f"""{ctes('profile', 'spec')},
p AS (SELECT *, coalesce({canonical_class('model')}, 'Unknown') AS model_class FROM profile),
pairs AS (SELECT p.profile_id, p.engine_size AS hint, s.spec_pos, s.displacement_l, (p.year BETWEEN s.year_min AND s.year_max) AS in_year
  FROM p JOIN spec s ON p.model_class = s.model_class),
tiers AS (SELECT *, bool_or(in_year) OVER (PARTITION BY profile_id) AS any_in FROM pairs),
kept AS (SELECT *, coalesce(hint, median(displacement_l) OVER (PARTITION BY profile_id)) AS target FROM tiers WHERE in_year OR NOT any_in),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id
  ORDER BY abs(displacement_l - target) ASC NULLS LAST, spec_pos) AS rn FROM kept) WHERE rn = 1)
SELECT p.profile_id, p.model_class, 'uk' AS source_market, coalesce(p.engine_size, s.displacement_cc / CAST(1000 AS DOUBLE)) AS engine_size,
  s.variant, s.torque_nm, coalesce(s.gear_type, 'Unknown') AS gear_type,
  CASE WHEN k.spec_pos IS NULL THEN 'none' WHEN NOT k.any_in THEN 'class_repr' WHEN p.engine_size IS NOT NULL THEN 'displacement'
    ELSE 'year_repr' END AS match_level, {soh_sql()} AS battery_soh, {offset_sql()} AS trans_adapt_offset
FROM p LEFT JOIN picked k ON p.profile_id = k.profile_id LEFT JOIN spec s ON k.spec_pos = s.spec_pos"""
