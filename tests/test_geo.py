"""Nearest sites through the cell index against all pairs."""

from __future__ import annotations

import math
import random

import pytest

from motoquant.operators import geo


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


def brute(vehicles, sites, k):
    return {v: [s for _, s in sorted((round(km(at, where), 6), s) for s, where in sites.items())[:k]] for v, at in vehicles.items()}


def found(spark, vehicles, sites, k):
    frame = lambda rows, name: spark.createDataFrame([(i, *p) for i, p in rows.items()], f"{name} long, lat double, lng double")
    rows = geo.nearest_sites(frame(vehicles, "vehicle_id"), frame(sites, "site_id"), k).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["vehicle_id"], r["rank"])):
        out.setdefault(r["vehicle_id"], []).append((r["site_id"], r["distance_km"]))
    return out


def places(rng, kind, n):
    if kind == "everywhere":
        return [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(n)]
    if kind == "date line":
        return [(rng.uniform(-3, 3), (179 + rng.uniform(0, 2) + 180) % 360 - 180) for _ in range(n)]
    if kind == "pole":
        return [(90 - abs(rng.gauss(0, 0.5)), rng.uniform(-180, 180)) for _ in range(n)] + [(90.0, 17.0)]
    return [(3 + rng.gauss(0, 0.01), 101 + rng.gauss(0, 0.01)) for _ in range(n)]


@pytest.mark.parametrize("kind", ["everywhere", "date line", "pole", "town"])
def test_index_equals_all_pairs(spark, kind):
    rng = random.Random(kind)
    sites = dict(enumerate(places(rng, kind, 400)))
    sites |= {1000 + i: sites[7] for i in range(40)}  # one position shared by many
    vehicles = dict(enumerate(places(rng, kind, 40) + places(rng, "everywhere", 10) + [(-90.0, 0.0), (0.0, 180.0), (0.0, -180.0), sites[7]]))
    got = found(spark, vehicles, sites, 5)
    for v, want in brute(vehicles, sites, 5).items():
        assert [round(d, 5) for _, d in got[v]] == [round(km(vehicles[v], sites[s]), 5) for s in want], (kind, v)
    assert [s for s, _ in got[max(vehicles)]] == [7, 1000, 1001, 1002, 1003]


def test_few_sites_no_sites_and_rows_without_a_position(spark):
    sites, vehicles = {1: (1.0, 2.0), 2: (1.0, 3.0), 3: (None, 4.0)}, {5: (0.0, 0.0), 6: (None, None), 7: (float("nan"), 1.0)}
    got = found(spark, vehicles, sites, 9)
    assert {v: [s for s, _ in r] for v, r in got.items()} == {5: [1, 2]}
    assert found(spark, vehicles, {3: (None, 4.0)}, 2) == {} and found(spark, {}, sites, 2) == {}


def test_every_pair_without_k(spark):
    rng = random.Random(1)
    sites, vehicles = dict(enumerate(places(rng, "town", 12))), dict(enumerate(places(rng, "town", 4)))
    got = found(spark, vehicles, sites, None)
    assert {v: [s for s, _ in r] for v, r in got.items()} == brute(vehicles, sites, 12)


def test_a_vehicle_far_away_meets_few_cells(spark):
    """A million sites in one country and a ship at sea: the candidates stay a handful."""
    sites = spark.range(1_000_000).selectExpr("id AS site_id", "48 + (id * 7919 % 1000003) / 500000.0 AS lat", "9 + (id * 104729 % 1000033) / 400000.0 AS lng").selectExpr("site_id", "cast(lat as double) lat", "cast(lng as double) lng")
    vehicles = spark.createDataFrame([(1, -40.0, -120.0), (2, 49.0, 10.0), (3, 48.5, 11.3)], "vehicle_id long, lat double, lng double")
    placed = geo._on_sphere(sites).cache()
    units = geo._on_sphere(vehicles).withColumn("unit", geo._cell(geo.UNIT_LEVEL)).groupBy("unit").agg(*geo._boxes())
    cells = geo.site_cells(placed).cache()
    per_unit = geo.candidate_cells(units, cells, 4).groupBy("unit").count().collect()
    assert len(per_unit) == 3 and max(r["count"] for r in per_unit) < 60
    got = {(r["vehicle_id"], r["rank"]): round(r["distance_km"], 6) for r in geo.nearest_sites(vehicles, sites, 4).collect()}
    for v, at in ((1, (-40.0, -120.0)), (2, (49.0, 10.0)), (3, (48.5, 11.3))):
        distance = geo.haversine_km(*[geo.F.lit(x) for x in at], geo.F.col("lat"), geo.F.col("lng"))
        want = [round(r[0], 6) for r in sites.select(distance.alias("d")).orderBy("d").limit(4).collect()]
        assert [got[v, n] for n in (1, 2, 3, 4)] == want
    placed.unpersist(), cells.unpersist()
