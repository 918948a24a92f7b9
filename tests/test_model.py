"""Models on small frames, and streams against their batch form."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motoquant.config import Rules
from motoquant.operators import bands as B
from motoquant.operators import bookings as BK
from motoquant.operators import metrics as MT
from motoquant.operators import model as ML
from motoquant.operators import telemetry as TM
from motoquant.plans import train as TR
from motoquant.sources import tables as S
from motoquant.streaming import bookings as SB
from motoquant.streaming import telemetry as ST

CAT, NUM = ["model_class", "fuel_type"], ["age", "mileage", "boot_l"]


@pytest.fixture(scope="module")
def cars(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(240):
        cls, age, km = "ABCDEF"[i % 6], int(rng.integers(1, 20)), float(rng.integers(0, 200000))
        price = 150000.0 + 9000 * (i % 6) - 4000 * age - 0.2 * km + float(rng.normal(0, 2000))
        data.append((i, cls, ["Petrol", "Diesel"][i % 2], age, km, None if i % 5 == 0 else 400.0 + i % 7, max(price, 4000.0)))
    return spark.createDataFrame(data, "id long, model_class string, fuel_type string, age int, mileage double, boot_l double, price_rm double").cache()


def test_trees_average_to_the_prediction(spark, cars, tmp_path):
    model = ML.fit(cars, ML.forest(trees=6, depth=5), CAT, NUM)
    table = ML.save_and_table(model, spark, str(tmp_path / "m"))
    scored = ML.with_tree_values(model.transform(cars), table)
    gap = scored.select(F.max(F.abs(B.array_mean("trees") - F.col("prediction")))).first()[0]
    assert gap < 1e-6
    joined = ML.with_tree_values(model.transform(cars), table, ["id"], Rules(forest_max_leaves=1))
    assert joined.select("id", "trees").exceptAll(scored.select("id", "trees")).count() == 0 and joined.count() == 240
    with pytest.raises(ValueError):
        ML.with_tree_values(model.transform(cars), table, rules=Rules(forest_max_leaves=1))
    band = B.percentile_band(scored)
    assert band.filter("low_rm > value_rm or value_rm > high_rm or low_rm < 0").count() == 0
    assert ML.tree_predictions(scored, "id").count() == 240 * 6


def test_unknown_category_is_all_zeros(spark, cars):
    pipe = ML.Pipeline(stages=ML.preprocessor(CAT, NUM)).fit(cars)
    odd = cars.limit(1).withColumn("model_class", F.lit("new")).withColumn("fuel_type", F.lit("new"))
    v = pipe.transform(odd).select(vector_to_array("features")).first()[0]
    assert v[: -len(NUM)] == [0.0] * (len(v) - len(NUM))


def test_ridge_is_the_closed_form(spark, cars):
    model = ML.fit(cars, ML.ridge(cars), CAT, NUM)
    rows = model.transform(cars).select(vector_to_array("features"), "price_rm").collect()
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 10.0 * np.eye(x.shape[1]), xc.T @ yc)
    assert np.allclose(model.stages[-1].coefficients.toArray(), want, rtol=1e-4, atol=1.0)


def test_cross_validation_and_importances(spark, cars, tmp_path, monkeypatch):
    monkeypatch.setattr(ML, "CATEGORICAL_FEATURES", CAT)
    monkeypatch.setattr(ML, "NUMERIC_FEATURES", NUM)
    folds, report = ML.cross_validate(cars, folds=2, trees=3, depth=3)
    assert folds.count() == 4 and {r["model"] for r in report.collect()} == {"random_forest", "ridge"}
    coverage = ML.band_coverage(cars, str(tmp_path / "cov"), folds=2, trees=5, depth=4).first()
    assert 0 <= coverage["empirical_coverage"] <= 1 and coverage["n"] == 240
    model = ML.fit(cars, ML.forest(trees=4, depth=4))
    top = ML.feature_importance(model, cars).collect()
    assert abs(sum(r["importance"] for r in top) - 1) < 1e-6
    perm = {r[0]: r[1] for r in ML.permutation_importance(model, cars, ["id"], CAT + NUM, repeats=2).collect()}
    assert perm["mileage"] > perm["boot_l"]
    numbered = ML._numbered(cars, ["id"], 7).agg(F.count_distinct("_rn"), F.min("_rn"), F.max("_rn"), F.max("_n")).first()
    assert tuple(numbered) == (240, 0, 239, 240)


def test_ablation_pairs_folds(spark, cars):
    got = ML.ablation(cars, ["id"], ["mileage"], CAT, ["age", "boot_l"], folds=2, trees=3, depth=4).collect()
    assert len(got) == 2 and all(r["r2_gain"] > 0 for r in got)


def test_saved_report(spark, cars, tmp_path):
    model = ML.fit(cars, ML.forest(trees=2, depth=2), CAT, NUM)
    scored = model.transform(cars)
    report = S.model_report(
        MT.regression_metrics(scored, "price_rm", "prediction"),
        MT.interval_coverage(scored, "price_rm", "prediction", "prediction"),
        cars.withColumn("source_market", F.lit("uk")), {"trees": 2}, Rules(),
    )
    S.save_model(model, report, str(tmp_path / "a"), spark)
    assert S.load_report(str(tmp_path / "a"), spark)["source_markets"] == {"uk": 240}


def test_train_job_end_to_end(spark, sf_dir, tmp_path):
    from motoquant.plans.standins import frame

    out = str(tmp_path / "job")
    report = TR.train(
        frame(spark, sf_dir, "uk_raw"), frame(spark, sf_dir, "germany_raw"), frame(spark, sf_dir, "spec_raw"), out,
        folds=2, trees=3, depth=3,
    )
    assert set(report["source_markets"]) == {"uk", "germany"} and report["n_rows"] > 0
    assert spark.read.parquet(f"{out}/engineered").count() == report["n_rows"]
    priced = TR.price(spark, out, frame(spark, sf_dir, "profile").limit(50), frame(spark, sf_dir, "spec"))
    assert priced.count() == 50 and priced.filter("low_rm > value_rm or value_rm > high_rm").count() == 0


def write_lines(path, name, records):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(records) + "\n")


def snapshot(v, sec, rpm=900):
    return json.dumps({"vehicle_id": v, "rpm": rpm, "coolant_c": 88.0, "battery_v": 13.7, "odo_km": 42000, "ts": f"2026-07-06T10:00:{sec:02d}"})


def test_stream_resumes_and_equals_batch(spark, tmp_path):
    src, out, mark = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "mark")
    vehicles = spark.createDataFrame([(1, 8, 8), (2, 2, 8)], "vehicle_id long, services_done int, services_due int")
    write_lines(src, "a.txt", [snapshot(1, 1), "{broken", snapshot(2, 2)])
    ST.append_to_table(ST.scored_stream(spark, str(src), vehicles), out, mark)
    write_lines(src, "b.txt", [snapshot(1, 5, 1000)])
    ST.append_to_table(ST.scored_stream(spark, str(src), vehicles), out, mark)
    batch = TM.score_snapshots(TM.parse_snapshots(spark.read.text(str(src))), vehicles)
    stream = spark.read.parquet(out)
    assert stream.count() == 3 and stream.exceptAll(batch).count() == 0

    latest, lmark = str(tmp_path / "latest"), str(tmp_path / "lmark")
    ST.keep_latest(TM.parse_snapshots(ST.event_lines(spark, str(src), 1)), latest, lmark)
    write_lines(src, "c.txt", [snapshot(2, 1, 5)])  # late: must not replace the newer one
    ST.keep_latest(TM.parse_snapshots(ST.event_lines(spark, str(src), 1)), latest, lmark)
    got = {r["vehicle_id"]: r["rpm"] for r in ST.read_latest(spark, latest).collect()}
    assert got == {1: 1000, 2: 900}


def test_negotiation_stream_equals_batch_over_restarts(spark, tmp_path):
    schema = T.StructType.fromDDL("booking_id long, status string, round int, last_update_id long, update_id long, intent string")
    first = [(1, "sent", 0, -1, 1, "unavailable"), (1, "sent", 0, -1, 2, "unclear"), (2, "sent", 3, -1, 4, "unavailable"), (3, "booked", 0, -1, 1, "unavailable")]
    second = [(1, "sent", 0, -1, 5, "confirmed"), (1, "sent", 0, -1, 4, "unavailable"), (1, "sent", 0, -1, 6, "unavailable"), (2, "sent", 3, -1, 5, "confirmed")]
    src = str(tmp_path / "src")
    for part in (first, second):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        got = SB.run_negotiation(spark, src, schema, str(tmp_path / "out"), str(tmp_path / "mark"))
    state = {r["booking_id"]: (r["status"], r["round"]) for r in got.collect()}
    events = spark.createDataFrame(first + second, schema)
    bookings = events.select("booking_id", "status", "round", F.col("last_update_id").alias("update_id")).distinct().withColumn(
        "calendar_id", F.lit("c")).withColumn("slot_at", F.lit("2026-07-06 10:00:00").cast("timestamp_ntz"))
    busy = spark.createDataFrame([], "calendar_id string, start timestamp_ntz, end timestamp_ntz")
    batch = {r["booking_id"]: (r["status"], r["round"]) for r in BK.negotiate(bookings, events.select("booking_id", "update_id", "intent"), busy).collect()}
    assert state == batch == {1: ("booked", 2), 2: ("failed", 3), 3: ("booked", 0)}


def test_folds_are_fitted_once_for_metrics_and_coverage(spark, cars, tmp_path, monkeypatch):
    monkeypatch.setattr(ML, "CATEGORICAL_FEATURES", CAT)
    monkeypatch.setattr(ML, "NUMERIC_FEATURES", NUM)
    held = ML.out_of_fold(cars, str(tmp_path / "folds"), folds=3, trees=4, depth=4, key=["id"])
    rows = held.collect()
    assert len(rows) == 240 and len({r["id"] for r in rows}) == 240 and all(len(r["trees"]) == 4 for r in rows)
    assert all(abs(sum(r["trees"]) / 4 - r["prediction"]) < 1e-6 * r["prediction"] for r in rows)
    metrics, report = ML.cross_validate(cars, folds=3, trees=4, depth=4, held=held)
    got = {(r["model"], r["fold"]): r for r in metrics.collect()}
    assert len(got) == 6 and {r["model"] for r in report.collect()} == {"random_forest", "ridge"}
    for k in range(3):
        own = [r for r in rows if r["fold"] == k]
        mae = sum(abs(r["price_rm"] - r["prediction"]) for r in own) / len(own)
        assert got["random_forest", k]["n"] == len(own) and math.isclose(got["random_forest", k]["mae"], mae, rel_tol=1e-9)
    assert ML.band_coverage(cars, "", held=held).first()["n"] == 240


def test_calibrated_band_covers_held_out_groups(spark, tmp_path):
    """k comes from some groups and holds its share of the prices of others."""
    rng = random.Random(6)
    rows = []
    for n in range(3000):
        value, spread = rng.uniform(8e4, 3e5), rng.uniform(500, 9000)
        trees = [math.log1p(value + rng.gauss(0, spread)) for _ in range(20)]
        rows.append((n, n % 10, value + rng.gauss(0, 2.2 * spread), trees))
    held = spark.createDataFrame(rows, "id long, fold int, price_rm double, trees array<double>")
    known, new = held.filter("fold < 5"), held.filter("fold >= 5")
    k = B.conformal_scale(known, "price_rm").first()["k"]
    inside = B.log_value_and_spread(new).select((F.abs(F.col("price_rm") - F.col("_v")) <= k * F.col("_sd")).cast("int").alias("i"))
    assert abs(inside.agg(F.avg("i")).first()[0] - 0.80) < 0.02
    per_fold = B.conformal_coverage(held, "price_rm", "fold").collect()
    assert len(per_fold) == 10 and abs(sum(r["coverage"] for r in per_fold) / 10 - 0.80) < 0.02
    band = B.calibrated_band(new, k=k).filter("low_rm <= price_rm + 0.5 and price_rm <= high_rm + 0.5").count() / new.count()
    assert abs(band - 0.80) < 0.02
    odd = spark.createDataFrame([(0, 5.0, [1.0, 1.0]), (1, None, [1.0, 2.0])], "fold int, price_rm double, trees array<double>")
    assert B.conformal_scale(odd, "price_rm").first()["k"] == float("inf")


def test_log_forest_job_prices_with_its_own_band(spark, sf_dir, tmp_path):
    from motoquant.plans.standins import frame

    out = str(tmp_path / "job")
    rows = TR.engineered(frame(spark, sf_dir, "uk_raw"), frame(spark, sf_dir, "germany_raw"), frame(spark, sf_dir, "spec_raw"))
    S.write_table(rows.withColumn("row_id", F.monotonically_increasing_id()), f"{out}/engineered")
    report = TR.train_log(spark.read.parquet(f"{out}/engineered"), out, folds=3, trees=5, depth=4)
    assert report["k"] > 0 and len(report["folds"]) == 3 and 0.5 < report["coverage_measured"] < 1
    priced = TR.price(spark, out, frame(spark, sf_dir, "profile").limit(40), frame(spark, sf_dir, "spec"), log=True)
    assert priced.count() == 40 and priced.filter("low_rm > value_rm or value_rm > high_rm or confidence > 1").count() == 0


def test_walk_over_saved_nodes_equals_the_fitted_forest(spark, cars, tmp_path):
    """Values of every tree, and importances, from the node table alone."""
    from motoquant.operators import forest as FO

    model = ML.fit(cars, ML.forest(trees=5, depth=6), CAT, NUM)
    table = ML.save_and_table(model, spark, str(tmp_path / "m"))
    scored = model.transform(cars)
    want = {r["id"]: r["trees"] for r in ML.with_tree_values(scored, table).collect()}
    nodes = FO.node_table(spark, str(tmp_path / "m"))
    rows = scored.select("id", vector_to_array("features").alias("features"))
    assert nodes.columns == FO.NODE_COLUMNS and 1 < FO.levels(nodes) <= 6
    for rules in (Rules(), Rules(broadcast_max_rows=3, salt_buckets=2)):
        got = {r["id"]: r["trees"] for r in FO.gather(FO.walk(rows, nodes, ["id"], rules=rules), ["id"]).collect()}
        assert got == want
    assert nodes.filter("go_left is not null").count() > 0 and nodes.filter("threshold is not null").count() > 0
    weights = model.stages[-1].featureImportances.toArray()
    found = {r["feature"]: r["importance"] for r in FO.impurity_importance(spark, str(tmp_path / "m")).collect()}
    assert all(math.isclose(found.get(i, 0.0), w, abs_tol=1e-9) for i, w in enumerate(weights))


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    from motoquant.operators import upsert as U
    from motoquant.sources.buckets import BucketTable

    schema = T.StructType.fromDDL("listing_url string, source string, price_rm long, scraped_at long")
    state = [(f"u{k}", "a", k, 1) for k in range(300)]
    batch = [("u7", "b", 70, 2), ("u7", "b", 71, 3), ("new", "b", 5, 2)]
    table = BucketTable(spark, str(tmp_path / "t"), "listing_url", schema, buckets=32)
    U.upsert_buckets(table, spark.createDataFrame(state, schema), 0, ["scraped_at"])
    touched = U.upsert_buckets(table, spark.createDataFrame(batch, schema), 1, ["scraped_at"], ["price_rm", "scraped_at"])
    assert len(touched) <= 2
    whole = U.upsert(spark.createDataFrame(state, schema), spark.createDataFrame(batch, schema), ["scraped_at"], fields=["price_rm", "scraped_at"])
    got = table.read()
    assert got.count() == 301 and got.exceptAll(whole.select(got.columns)).count() == 0
    assert got.filter("listing_url = 'u7'").first()["source"] == "a"
