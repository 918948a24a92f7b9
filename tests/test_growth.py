"""Plans and results past the sizes at which a table is broadcast or a step is repeated per row."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from motoquant.config import Rules
from motoquant.functions import noise
from motoquant.functions.noise import poisson
from motoquant.operators import harmonise, joins, match


def plan_of(df, stage="executedPlan"):
    return getattr(df._jdf.queryExecution(), stage)().toString()


def test_salted_table_is_not_broadcast(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    table = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = joins.lookup_join(rows, table, "k", checked=False)
    assert "BroadcastExchange" not in plan_of(got)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [(i % 7, i, i % 7 * 10 if i % 7 < 5 else None) for i in range(100)]


CARS = "id int, model_class string, year int, engine_hint double, engine_size double, source_market string"
SPECS = """spec_pos int, variant string, model_class string, year_min int, year_max int, displacement_l double, displacement_cc double,
  n_cylinders double, n_gears double, top_speed_kmh double, torque_nm double, accel_0_100_s double, boot_l double,
  engine_config string, aspiration string, gear_type string, front_brake string, rear_brake string"""


def catalogue(spark, n, twice=False):
    """Many specs of few candidates: two classes, three year ranges, three displacements."""
    own = [(i, f"v{i}", "AB"[i % 2], 2000 + i % 3, 2003 + i % 3, (None, 1.5, 2.0)[i // 6 % 3], (None, 1500.0, 2000.0)[i // 6 % 3],
            4.0, 6.0, 200.0, 300.0, 7.0, 400.0, "L4", "turbo", "manual", "Discs", "Drums") for i in range(n)]
    return spark.createDataFrame(own * (1 + twice), SPECS)


def cars(spark, hints):
    return spark.createDataFrame([(i, ("A", "B", "Q", None)[i % 4], (None, 2001, 2004, 2015)[i % 5 % 4], hints[i % len(hints)], None, "uk") for i in range(120)], CARS)


def test_match_joins_a_large_catalogue_without_repeating_it(spark):
    few, many = [None, 1.4, 1.9], [None, *(1.0 + i / 97 for i in range(110))]
    for hints, rules in ((few, Rules(broadcast_max_rows=70)), (many, Rules(broadcast_max_rows=70))):
        listed = cars(spark, hints)
        for twice in (False, True):
            specs = catalogue(spark, 150, twice)
            got = match.nearest_spec(listed, specs, rules)
            assert "_salt" not in plan_of(got, "analyzed")
            kept = got.orderBy("id", "variant").collect()
            assert kept == match.nearest_spec(listed, specs).orderBy("id", "variant").collect()
            known = sum(r["match_level"] != "none" for r in kept)
            assert len(kept) - known + known // (1 + twice) == 120


def test_listings_rank_no_candidates_themselves(spark):
    got = match.nearest_spec(cars(spark, [None, 1.4]), catalogue(spark, 60))
    assert "transform(" not in plan_of(got, "analyzed")


def test_poisson_takes_its_hash_once(spark):
    draw = spark.range(10).select((F.col("id") / 3.0).alias("lam"), "id").select(poisson("lam", ["id"], "t", 1).alias("x"))
    assert plan_of(draw, "analyzed").count("md5(") == 2  # one for plain means, one for means in shares


def test_short_walks_hold_their_draws(spark):
    # the draw by the whole walk, in plain Python, next to every bound of the uniform at which the walk gets longer
    lams = [0.0, 0.01, 0.4, 0.69, 1.0, 1.6, 2.68, 7.3, 55.5, 499.9]
    us = [1e-9, 0.2, 0.49989, 0.4999, 0.5, 0.85999, 0.86, 0.99, 0.9999989, 0.9999999]
    df = spark.createDataFrame([(a, b) for a in lams for b in us], "lam double, u double")

    def whole(lam, u):
        mass = total = math.exp(-lam)
        k, i = 0, 0
        while total < u and i < 2000:
            i += 1
            mass = mass * lam / i
            total, k = total + mass, k + 1
        return k

    for lam, u, k in df.select("lam", "u", noise._walk(F.col("lam"), F.col("u"))).collect():
        assert k == whole(lam, u), (lam, u)


def test_ledger_reads_the_first_copy(spark):
    """Copies of a key that differ in a column before, among and behind those that the ledger reads."""
    kind = "k int, row int, n_gears double, top_speed_kmh double, torque_nm double, accel_0_100_s double, boot_l double, engine_size double, note string"
    rows = [(1, 2, 6.0, 200.0, 300.0, 7.0, 400.0, 0.0, "a"), (1, 1, 6.0, 200.0, 3000.0, 7.0, 400.0, 1.0, "z"),
            (2, 1, 6.0, 200.0, 300.0, 7.0, None, 0.0, "b"), (2, 1, 6.0, 200.0, 300.0, 7.0, 400.0, 0.0, "a"), (3, 1, 5.0, 180.0, 250.0, 9.0, 300.0, 0.0, "c")]
    got = harmonise.cleaning_ledger(spark.createDataFrame(rows, kind), keys=["k"])
    assert not any("note" in line for line in plan_of(got).splitlines() if "Aggregate" in line)
    assert [tuple(r)[1:] for r in got.orderBy("step").collect()] == [(0, 5), (2, 3), (2, 3), (1, 3), (2, 1)]
