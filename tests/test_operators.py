"""Operators on small frames: golden cases and properties."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motoquant.config import Rules
from motoquant.operators import bands, comps, curves, geo, harmonise, match, metrics, profile, quantiles, upsert
from motoquant.operators import bookings as B
from motoquant.operators import contract as K
from motoquant.operators import telemetry as TM
from motoquant.plans import queries_core  # noqa: F401
from motoquant.plans.standins import frame
from motoquant.sources import tables as S


def rows(df):
    return sorted(tuple(r) for r in df.collect())


SPEC = (
    "spec_pos long, variant string, model_class string, year_min int, year_max int, displacement_cc double, displacement_l double, "
    "n_cylinders double, n_gears double, top_speed_kmh double, torque_nm double, accel_0_100_s double, boot_l double, "
    "engine_config string, aspiration string, gear_type string, front_brake string, rear_brake string"
)


def spec(pos, cls, y0, y1, cc, torque=400.0):
    litres = None if cc is None else cc / 1000.0
    return (pos, f"v{pos}", cls, y0, y1, cc, litres, 4.0, 7.0, 233.0, torque, 7.5, 540.0, "L4", "turbo", "automatic", "Discs", "Discs")


LISTING = "model_class string, year int, mileage double, transmission string, fuel_type string, engine_size double, engine_hint double, price_rm long, source_market string, id int"


def listing(i, cls, year, hint):
    return (cls, year, 1000.0, "Manual", "Petrol", None, hint, 50000, "uk", i)


def brute_match(one, specs):
    cands = [s for s in specs if s[2] == one[0]]
    if not cands:
        return None, "none"
    inside = [s for s in cands if s[3] <= one[1] <= s[4]]
    use = inside or cands
    known = [s for s in use if s[6] is not None]
    target = one[6] if one[6] is not None else (float(np.median([s[6] for s in known])) if known else None)
    best = min(known, key=lambda s: (abs(s[6] - target), s[0])) if known else min(use, key=lambda s: s[0])
    level = ("displacement" if one[6] is not None else "year_repr") if inside else "class_repr"
    return best[0], level


def test_nearest_spec_against_brute_force(spark):
    rng = random.Random(7)
    specs = [spec(i, rng.choice("ABCDE"), y, y + rng.randint(0, 6), rng.choice([None, 1500.0, 1991.0, 2143.0, 2987.0, 5461.0]))
             for i in range(80) for y in [rng.randint(1995, 2020)]]
    specs += [spec(90, "Z", 2000, 2001, None), spec(91, "Z", 2000, 2001, None)]
    cars = [listing(i, rng.choice(["A", "B", "C", "D", "E", "Z", "Q", None]), rng.randint(1992, 2026), rng.choice([None, 1.5, 2.0, 2.1, 3.0])) for i in range(400)]
    got = match.enrich(spark.createDataFrame(cars, LISTING), spark.createDataFrame(specs, SPEC)).select("id", "variant", "match_level", "front_brake").collect()
    assert len(got) == len(cars)
    for r in got:
        pos, level = brute_match(cars[r["id"]], specs)
        assert (r["variant"], r["match_level"]) == (f"v{pos}" if pos is not None else None, level)
        assert r["front_brake"] == ("Unknown" if level == "none" else "Discs")


def test_nearest_spec_shuffle_path_agrees(spark):
    specs = spark.createDataFrame([spec(i, "A", 2000 + i, 2005 + i, 1000.0 + 100 * i) for i in range(9)], SPEC)
    cars = spark.createDataFrame([listing(i, "A", 1998 + i, None if i % 3 else 1.4) for i in range(20)], LISTING)
    small = Rules(broadcast_max_rows=1)
    assert rows(match.enrich(cars, specs).select("id", "variant")) == rows(match.enrich(cars, specs, small).select("id", "variant"))


def test_match_plan_has_no_nested_loop(spark, sf_dir):
    df = match.nearest_spec(frame(spark, sf_dir, "listing"), frame(spark, sf_dir, "spec"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


MARKET = "listing_url string, model string, year int, price_rm long, source string"


def test_comps_golden(spark):
    data = [("u1", "C", 2018, 200000, "a"), ("u2", "C", 2019, 220000, "a"), ("u3", "C", 2011, 90000, "a"),
            ("u4", "SL", 2016, 700000, "a"), ("u5", "SL", 2017, 700000, "a")]
    market = spark.createDataFrame(data, MARKET)
    subjects = spark.createDataFrame(
        [(1, "C", 2018, None), (2, "SL", 2017, 770000), (3, "C", 2018, 252000), (4, "ZZ", 2018, 5), (5, "C", None, 200000)],
        "subject_id long, model string, year int, predicted_rm long")
    got = {r["subject_id"]: (r["n"], r["median_rm"], r["delta_pct"]) for r in comps.comps_summary(subjects, market, 10).collect()}
    assert got[1] == (2, 210000, None)
    assert got[2] == (2, 700000, 0.1) and got[3] == (2, 210000, 0.2)
    assert got[4] == (0, None, None) and got[5] == (3, 200000, 0.0)


def test_comps_against_brute_force(spark):
    rng = random.Random(3)
    data = [(f"u{i:04d}", rng.choice("AB"), rng.randint(2000, 2020), rng.choice([10, 20, 30]) * 1000, "x") for i in range(300)]
    subs = [(i, rng.choice("ABQ"), rng.choice([None, *range(1994, 2027)]), 1000) for i in range(80)]
    for limit in (2, 5, 100):
        found = comps.comps(spark.createDataFrame(subs, "subject_id long, model string, year int, predicted_rm long"),
                            spark.createDataFrame(data, MARKET), limit).select("subject_id", "comp_rank", "listing_url").collect()
        got = {}
        for r in found:
            got.setdefault(r[0], {})[r[1]] = r[2]
        for i, model, year, _ in subs:
            def take(w):
                pool = [d for d in data if d[1] == model and (year is None or abs(d[2] - year) <= w)]
                return sorted(pool, key=lambda d: (-d[2], d[3], d[0]))[:limit]
            want = take(2)
            if year is not None and len(want) < 3:
                want = take(5)
            assert [got.get(i, {}).get(k + 1) for k in range(len(want))] == [w[0] for w in want]
            assert len(got.get(i, {})) == len(want)


def test_comps_trims_before_the_shuffle(spark, sf_dir):
    df = comps.comps_summary(frame(spark, sf_dir, "subject"), frame(spark, sf_dir, "market_listing"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_upsert_twice_is_once(spark):
    state = spark.createDataFrame([("a", "s1", 1, 10), ("b", "s1", 2, 20)], "listing_url string, source string, year int, price_rm long")
    batch = spark.createDataFrame([("b", "s2", 3, 30, 1), ("c", "s2", 4, 40, 1), ("c", "s2", 5, 50, 2)], "listing_url string, source string, year int, price_rm long, seq int")
    once = upsert.upsert(state, batch, ["seq"])
    assert rows(once) == [("a", "s1", 1, 10), ("b", "s1", 3, 30), ("c", "s2", 5, 50)]
    assert rows(upsert.upsert(once, batch, ["seq"])) == rows(once)


def test_fault_codes(spark):
    schema = "source_file string, layer string, dtcs array<struct<trouble_code:string,short_name:string,display_code:string,text:string>>, services array<struct<short_name:string,responses:array<string>>>"
    data = [("f1", "eng", [("P1", "n", None, "t"), ("", "n2", None, None)], []), ("f1", "gear", [], [("report_status", ["r"])]),
            ("f2", "abs", [], [("other", []), ("report_status", ["r1", "r2"])]), ("f3", "none", [], [])]
    got = rows(upsert.fault_codes(spark.createDataFrame(data, schema)).drop("pos"))
    assert got == [("f1", "P1", "t", "warn", "eng"), ("f1", "n2", "n2", "warn", "eng"),
                   ("f2", "ODX-REPORT-STATUS", "ODX diagnostic service exposes r1, r2", "info", "abs")]


def test_clean_pool_and_keep_first(spark):
    data = [("C", 2017.0, 10000.0, "Manual", "Petrol", 2.0, 2.0, 59000.5, "uk"), ("C", 1965.0, 1.0, "Manual", "Petrol", 2.0, 2.0, 59000.0, "uk"),
            (None, 2017.0, 1.0, "Manual", "Petrol", 2.0, 2.0, 59000.0, "uk")]
    schema = "model_class string, year double, mileage double, transmission string, fuel_type string, engine_size double, engine_hint double, price_rm double, source_market string"
    got = harmonise.clean_pool(spark.createDataFrame(data * 2, schema)).collect()
    assert len(got) == 1 and got[0]["age"] == 9 and got[0]["price_rm"] == 59000
    kept = harmonise.keep_first(spark.createDataFrame([("k", 2, "b"), ("k", 1, "c")], "k string, o int, v string"), ["k"], ["o"])
    assert rows(kept) == [("k", 1, "c")]


def test_rate_curve_and_advice(spark):
    p = spark.createDataFrame([(1, 2024, 100000, None), (2, 2026, None, 50000)], "profile_id long, year int, original_purchase_price_rm long, predicted_rm long")
    curve = curves.rate_curve(p, 2)
    one = curve.filter("profile_id = 1").orderBy("step").collect()
    assert [r["value_rm"] for r in one] == [90250, 85738, 81451] and [r["retained_pct"] for r in one] == [0.9025, 0.8574, 0.8145]
    advice = {r["profile_id"]: r for r in curves.repair_or_sell(curve).collect()}
    assert advice[1]["recommendation"] == "Sell" and advice[1]["depreciation_loss_rm"] == 8799
    scored = spark.createDataFrame([(1, 2020, s, v) for s, v in enumerate([100.0, 120.0, 90.0, -5.0])], "profile_id long, year int, step int, prediction double")
    got = curves.model_curve(scored).orderBy("step").collect()
    assert [r["value_rm"] for r in got] == [100, 100, 90, 0] and got[2]["retained_pct"] == 0.9


def test_metrics_golden(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 200.0), (10000.0, 9000.0)], "y double, p double")
    low = metrics.regression_metrics(df, "y", "p").first()
    assert low["mape"] == pytest.approx(10.0)
    flat = spark.createDataFrame([(5.0, 4.0), (5.0, 6.0)], "y double, p double")
    got = metrics.regression_metrics(flat, "y", "p").first()
    assert got["r2"] == 0.0 and got["mape"] is None and got["mae"] == 1.0


def test_group_folds_disjoint_and_balanced(spark):
    df = spark.createDataFrame([(g, i) for g, n in zip("abcdef", [60, 30, 29, 20, 10, 1]) for i in range(n)], "g string, i int")
    got = metrics.group_folds(df, "g", 3).groupBy("fold").agg(F.count("*").alias("n"), F.collect_set("g").alias("gs")).collect()
    assert sum(len(r["gs"]) for r in got) == 6 and sorted(r["n"] for r in got) == [41, 49, 60]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    groups = {"hot": np.round(rng.lognormal(3, 1, 30000), 1), "flat": np.full(500, 7.0), "one": np.array([3.0])}
    data = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame(data, "g string, x double").repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.96, 1.0]
    for r in quantiles.exact_quantiles(df, ["x"], probs, ["g"]).collect():
        assert r["value"] == pytest.approx(float(np.percentile(groups[r["g"]], r["prob"] * 100)), abs=1e-9)
        assert r["n"] == len(groups[r["g"]])


def test_profile_tables(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None), (None, "a"), (100.0, "b")], "x double, c string")
    assert [tuple(r) for r in profile.usable_rows(df).collect()] == [(0, 2, 50.0), (1, 4, 100.0)]
    filled = profile.impute(df, ["x"], ["c"])
    assert rows(filled) == [(1.0, "a"), (2.0, "a"), (2.0, "a"), (100.0, "b")]
    hist = profile.histogram(df, "x", 4).orderBy("bin").collect()
    assert [r["n"] for r in hist] == [2, 0, 0, 1]
    vif = {r[0]: r[1] for r in profile.variance_inflation(
        spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0)], "a double, b double"), ["a", "b"]).collect()}
    gram = np.array([[14.0, 19.0], [19.0, 30.0]])
    assert vif["a"] == pytest.approx(gram[0, 0] * np.linalg.inv(gram)[0, 0])


def test_bands(spark):
    trees = [10.0, 20.0, 30.0, 400.0, 15.0]
    df = spark.createDataFrame([(trees,)], "trees array<double>")
    got = bands.percentile_band(df).first()
    assert got["value_rm"] == 95 and got["low_rm"] == round(np.percentile(trees, 4)) and got["high_rm"] == round(np.percentile(trees, 96))
    logs = spark.createDataFrame([([math.log1p(t) for t in trees],)], "trees array<double>")
    cal = bands.calibrated_band(logs).first()
    w = 1.6737 * np.std(trees)
    assert cal["value_rm"] == 20 and cal["low_rm"] == 0 and cal["high_rm"] == round(20 + w) and cal["confidence"] == 0.0


def test_nearest_sites_chunks_agree(spark, monkeypatch):
    v = spark.createDataFrame([(i, 3.0 + i / 10, 101.5) for i in range(5)], "vehicle_id long, lat double, lng double")
    s = spark.createDataFrame([(i, 3.0 + i / 7, 101.0 + i / 9) for i in range(40)], "site_id long, lat double, lng double")
    whole = rows(geo.nearest_sites(v, s, k=3).select("vehicle_id", "rank", "site_id"))
    monkeypatch.setattr(geo, "SITES_PER_CHUNK", 7)
    assert rows(geo.nearest_sites(v, s, k=3).select("vehicle_id", "rank", "site_id")) == whole
    assert geo.nearest_sites(v, s).count() == 200


T0 = dt.datetime(2026, 7, 6)


def slot(h, d=0, m=0):
    return T0 + dt.timedelta(days=d, hours=h, minutes=m)


def test_slots(spark):
    busy = spark.createDataFrame([("c", slot(10), slot(11)), ("full", slot(0), slot(24)), ("half", slot(9, m=30), slot(9, m=30))], "calendar_id string, start timestamp_ntz, end timestamp_ntz")
    days = spark.createDataFrame([("c", T0.date()), ("none", T0.date()), ("full", T0.date()), ("half", T0.date())], "calendar_id string, day date")
    got = {}
    for r in B.free_slots(days, busy).collect():
        got.setdefault(r["calendar_id"], set()).add(r["slot"])
    every = {f"{h:02d}:00" for h in range(9, 18)}
    assert got["c"] == every - {"10:00"} and got["none"] == every and "full" not in got and got["half"] == every - {"09:00"}
    want = spark.createDataFrame([(1, "none", slot(10)), (2, "full", slot(16)), (3, "c", slot(9)), (4, "jam", slot(17))], "booking_id long, calendar_id string, slot_at timestamp_ntz")
    jam = busy.unionByName(spark.createDataFrame([("jam", slot(0), slot(0, d=40))], busy.schema))
    nxt = {r["booking_id"]: r["next_slot"] for r in B.next_free_slot(want, jam).collect()}
    assert nxt == {1: slot(11), 2: slot(9, d=1), 3: slot(11), 4: slot(9, d=1)}


def test_match_replies(spark):
    bookings = spark.createDataFrame(
        [(12, "x", "sent", "m12", None, slot(10, m=5)), (123, "x", "sent", "m123", None, slot(10)), (7, "solo", "sent", "m7", 50, slot(10)), (8, "x", "booked", "m8", None, slot(1))],
        "booking_id long, chat_id string, status string, message_id string, update_id long, updated_at timestamp_ntz")
    replies = spark.createDataFrame(
        [(1, "x", None, "ok for BKG-123", slot(11)), (2, "x", "m12", "busy", slot(10)), (3, "x", "m12", " ", slot(12)), (4, "x", None, "plain yes", slot(13)),
         (5, "y", None, "BKG-12 yes", slot(13)), (49, "solo", None, "yes", slot(12)), (51, "solo", None, "no", slot(11)), (52, "solo", None, "yes", slot(11))],
        "update_id long, chat_id string, reply_to_message_id string, text string, ts timestamp_ntz")
    got = {r["booking_id"]: (r["update_id"], r["intent"]) for r in B.match_replies(bookings, replies).collect()}
    # a reference to 123 also holds the text of 12
    assert got == {12: (1, "confirmed"), 123: (1, "confirmed"), 7: (52, "confirmed")}


def test_negotiation(spark):
    bookings = spark.createDataFrame(
        [(1, "c", "sent", slot(10), 0, None), (2, "c", "sent", slot(10), 3, None), (3, "c", "booked", slot(10), 0, 9), (4, "c", "confirmed", slot(10), 1, 9), (5, "c", "sent", slot(16), 0, 5)],
        "booking_id long, calendar_id string, status string, slot_at timestamp_ntz, round int, update_id long")
    events = [(1, 1, "unavailable"), (1, 2, "unclear"), (1, 3, "unavailable"), (1, 4, "confirmed"), (1, 5, "unavailable"),
              (2, 1, "unavailable"), (3, 10, "unavailable"), (5, 4, "confirmed"), (5, 6, "unclear")] + [(5, 10 + i, "unavailable") for i in range(2)]
    busy = spark.createDataFrame([("c", slot(11), slot(12))], "calendar_id string, start timestamp_ntz, end timestamp_ntz")
    got = {r["booking_id"]: (r["status"], r["round"], r["slot_at"], r["update_id"]) for r in B.negotiate(
        bookings, spark.createDataFrame(events, "booking_id long, update_id long, intent string"), busy).collect()}
    assert got[1] == ("booked", 2, slot(13), 4) and got[2] == ("failed", 3, slot(10), 1)
    assert got[3] == ("booked", 0, slot(10), 9) and got[4] == ("booked", 1, slot(10), 9)
    assert got[5] == ("sent", 2, slot(9, d=1), 11)


def test_telemetry_score_and_malformed(spark):
    lines = ['{"vehicle_id":1,"rpm":900,"coolant_c":88.0,"battery_v":13.7,"odo_km":42000,"ts":"2026-07-06T10:00:00"}', '{"vehicle_id":1,"rp', "",
             '{"vehicle_id":2,"rpm":900,"coolant_c":104.0,"battery_v":12.4,"odo_km":180000,"ts":"2026-07-06T10:00:00"}']
    events = TM.parse_snapshots(spark.createDataFrame([(x,) for x in lines], "value string"))
    vehicles = spark.createDataFrame([(1, 8, 8), (2, 2, 8)], "vehicle_id long, services_done int, services_due int")
    faults = spark.createDataFrame([(1, 0), (2, 3)], "vehicle_id long, fault_count long")
    got = {r["vehicle_id"]: r["health"] for r in TM.score_snapshots(events, vehicles, faults).collect()}
    # 100 - 15 (services) - 24 (faults) - 8 (km) - 12 (volts) - 12 (coolant)
    assert got == {1: 100, 2: 29}


def test_contract_split(spark):
    df = spark.createDataFrame([(2000, 1.0, 1.0, None, None, None), (1900, 1.0, 1.0, None, None, None), (2000, None, 1.0, -1, None, None)],
                               "year int, mileage double, engine_size double, original_purchase_price_rm long, service_history_count int, service_history_total int")
    good, bad = K.split_by_contract(df, K.profile_rules())
    assert good.count() == 1 and sorted(r["violation"] for r in bad.collect()) == ["mileage >= 0", "year 1970-2100"]


def test_sources_round_trip(spark, tmp_path):
    path = str(tmp_path / "spec.csv")
    with open(path, "w") as f:
        f.write(",".join(f'"{c}"' for c in S.SPEC_COLUMNS) + "\n")
        for i in range(5):
            f.write(",".join(f'"{c[:3]}{i}"' for c in S.SPEC_COLUMNS) + "\n")
    got = S.read_specs(spark, path).orderBy("spec_pos").collect()
    assert [r["Model"] for r in got] == [f"Mod{i}" for i in range(5)]
    table = str(tmp_path / "append")
    new = spark.createDataFrame([("u1", 1), ("u1", 2), ("u2", 3)], "source_url string, v int")
    assert S.append_with_resume(new, table) == 2 and S.append_with_resume(new, table) == 0
    raw = spark.createDataFrame(
        [("230", "2007", "4500", "Automatic", "94000", "Petrol", "0", "29", "0"), ("C Class", "2017", "10000", "Automatic", "10000", "Petrol", "0", "40", "2.0"),
         ("C Class", "1969", "10000", "Automatic", "0", "Petrol", "0", "40", "2.0"), ("Unknown", "2017", "10000", "Automatic", "0", "Petrol", "0", "40", "2.0")],
        ", ".join(f"{c} string" for c in S.UK_COLUMNS))
    ledger = S.reload_training(raw, str(tmp_path / "train"), 2026, 5.90).first()
    assert tuple(ledger) == (4, 1, 2, 1, 59000, 59000)
    S.reload_training(raw, str(tmp_path / "train"), 2026, 5.90)
    assert rows(spark.read.parquet(str(tmp_path / "train")).select("model", "age", "price_rm")) == [("C_CLASS", 9, 59000)]
