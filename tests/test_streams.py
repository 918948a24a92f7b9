"""Keyed streams: any order of arrival gives the batch answer, state is bounded, tables rewrite what they must."""

from __future__ import annotations

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motoquant.config import DEFAULT
from motoquant.operators import bookings as BK
from motoquant.operators import telemetry as TM
from motoquant.sources.buckets import BucketTable
from motoquant.streaming import bookings as SB
from motoquant.streaming import telemetry as ST

STATES = "booking_id long, status string, round int, last_update_id long, update_id long, intent string, ts timestamp"


def snapshot(v, at, rpm=900):
    when = (dt.datetime(2026, 7, 6) + dt.timedelta(seconds=at)).isoformat()
    return json.dumps({"vehicle_id": v, "rpm": rpm, "coolant_c": 88.5, "battery_v": 13.7, "odo_km": None, "ts": when})


def write_lines(path, name, records):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(records) + "\n")


def state_rows(progress):
    return [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(p.json) if hasattr(p, "json") else p for p in progress) if p["stateOperators"]]


def latest_of(spark, src, out, mark, **more):
    return ST.keep_latest(TM.parse_snapshots(ST.event_lines(spark, str(src), 1)), out, mark, buckets=8, **more)


@pytest.mark.parametrize("seed", [1, 2])
def test_latest_equals_batch_for_shuffled_files(spark, tmp_path, seed):
    rng = random.Random(seed)
    lines = [snapshot(rng.randrange(12), rng.randrange(300), rng.choice((500, 900, 1300))) for _ in range(150)] + ["{broken"] * 5
    rng.shuffle(lines)
    src, out, mark = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "mark")
    cuts = sorted(rng.sample(range(1, len(lines)), 3))
    parts = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, None])]
    for k, part in enumerate(parts):
        write_lines(src, f"{k}.txt", part)
        if k in (1, 3):  # two runs, so that the second one resumes
            latest_of(spark, src, out, mark)
    got, want = ST.read_latest(spark, out), TM.latest_snapshot(TM.parse_snapshots(spark.read.text(str(src))))
    assert got.schema == want.schema and got.count() == want.count() and got.exceptAll(want).count() == 0


def test_silent_vehicles_leave_the_state_but_not_the_table(spark, tmp_path):
    src, out, mark = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "mark")
    ttl = {"ttl_days": 0.5 / 86_400}
    write_lines(src, "a.txt", [snapshot(v, 10) for v in range(20)])
    first = state_rows(latest_of(spark, src, out, mark, **ttl))
    time.sleep(2)
    write_lines(src, "b.txt", [snapshot(50, 5), snapshot(3, 4, 100)])  # vehicle 3 is back with an old event
    second = state_rows(latest_of(spark, src, out, mark, **ttl))
    assert first[-1] == 20 and second[-1] <= 2
    got = {r["vehicle_id"]: r["rpm"] for r in ST.read_latest(spark, out).collect()}
    assert got == {v: 900 for v in [*range(20), 50]}


def test_buckets_rewrite_only_what_a_batch_touches(spark, tmp_path):
    schema = T.StructType.fromDDL("k long, v string")
    table = BucketTable(spark, str(tmp_path / "t"), "k", schema, buckets=16)
    newest = lambda stored, new: stored.join(new, "k", "left_anti").unionByName(new)
    assert table.read().count() == 0
    table.merge(spark.createDataFrame([(k, "a") for k in range(200)], schema), 0, newest)
    one = spark.createDataFrame([(7, "b"), (7000, "b")], schema)
    touched = table.merge(one, 3, newest)
    assert len(touched) <= 2 and {b for b, v in table.held(3).items() if v == 3} == touched
    want = {k: "b" if k in (7, 7000) else "a" for k in [*range(200), 7000]}
    assert {r["k"]: r["v"] for r in table.read().collect()} == want
    # the same batch again, as after a failure, starts from the version before
    assert table.merge(one, 3, newest) == touched and {r["k"]: r["v"] for r in table.read().collect()} == want
    assert table.merge(spark.createDataFrame([], schema), 4, newest) == set() and table.read().count() == 201
    for version in range(5, 9):
        table.merge(spark.createDataFrame([(7, f"c{version}")], schema), version, newest)
    assert table.versions() == [7, 8] and {r["v"] for r in table.read().filter("k = 7").collect()} == {"c8"}
    assert {r["v"] for r in table.read(7).filter("k = 7").collect()} == {"c7"} and table.read(7).count() == 201
    folders = [p.name for p in (tmp_path / "t" / "data" / "version=3").iterdir() if p.is_dir()]
    assert len(folders) <= 1  # the bucket of key 7 has moved on
    gone = table.merge(spark.createDataFrame([(7, "x")], schema), 9, lambda stored, new: stored.join(new, "k", "left_anti"))
    assert len(gone) == 1 and table.read().filter("k = 7").count() == 0 and table.read().count() == 200


def walk(status, round_, base, replies, max_rounds):
    """Replies one by one in order of their id."""
    moves = 0
    if status == "confirmed":
        status = "booked"
    for u, intent in sorted(set(replies)):
        if status != "sent" or u <= base:
            continue
        if intent == "confirmed":
            status = "booked"
        elif intent == "unavailable" and round_ >= max_rounds:
            status = "failed"
        elif intent == "unavailable":
            round_, moves = round_ + 1, moves + 1
    return status, round_, moves


def at(second):
    return dt.datetime(2026, 7, 6, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=second)


def replies_of(rng, bookings, n):
    """One reply per second, update ids in the order of time."""
    out = []
    for u in range(1, n + 1):
        b = rng.randrange(len(bookings))
        status, round_, base = bookings[b]
        out.append((b, status, round_, base, u, rng.choice(("unavailable", "unavailable", "unclear", "confirmed")), at(u)))
    return out


def test_replies_fold_to_the_same_outcome_in_any_order():
    rng = random.Random(8)
    for _ in range(300):
        status, round_, base = rng.choice(("sent", "sent", "sent", "confirmed", "failed")), rng.randrange(5), rng.choice((-1, 4))
        replies = [(u, rng.choice(("confirmed", "unavailable", "unavailable", "unclear"))) for u in rng.sample(range(1, 20), rng.randrange(9))]
        rng.shuffle(replies)
        known = SB.Replies(status, round_, base)
        cut = rng.randrange(len(replies) + 1)
        for part in (replies[:cut], replies[cut:]):
            known.add([u for u, _ in part], [i for _, i in part], [u for u, _ in part], DEFAULT.max_rounds + 1)
        assert known.outcome(DEFAULT.max_rounds)[:3] == walk(status, round_, base, replies, DEFAULT.max_rounds)
        assert len(known.no) <= DEFAULT.max_rounds + 1


@pytest.mark.parametrize("seed", [3, 4])
def test_negotiation_equals_batch_for_any_split_within_the_watermark(spark, tmp_path, seed):
    rng = random.Random(seed)
    bookings = [(rng.choice(("sent",) * 6 + ("confirmed", "booked")), rng.randrange(4), rng.choice((-1, -1, 3))) for _ in range(25)]
    replies = replies_of(rng, bookings, 240)
    arrived = sorted(replies, key=lambda r: r[4] + rng.random() * 55)  # up to 55 seconds late
    src, out, mark = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "mark")
    cuts = [0, *sorted(rng.sample(range(1, 240), 4)), 240]
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame(arrived[a:b], STATES).coalesce(1).write.mode("append").parquet(src)
        got = SB.run_negotiation(spark, src, STATES, out, mark, files_per_batch=1, delay="60 seconds", buckets=4)
    want = {b: walk(*bookings[b], [(r[4], r[5]) for r in replies if r[0] == b], DEFAULT.max_rounds) for b in {r[0] for r in replies}}
    assert {r["booking_id"]: (r["status"], r["round"], r["moves"]) for r in got.collect()} == want
    slots = spark.createDataFrame([(b, "c", s, r, u, "2026-07-06 10:00:00") for b, (s, r, u) in enumerate(bookings)], "booking_id long, calendar_id string, status string, round int, update_id long, at string")
    busy = spark.createDataFrame([], "calendar_id string, start timestamp_ntz, end timestamp_ntz")
    batch = BK.negotiate(slots.withColumn("slot_at", F.col("at").cast("timestamp_ntz")), spark.createDataFrame([(r[0], r[4], r[5]) for r in replies], "booking_id long, update_id long, intent string"), busy)
    assert {r["booking_id"]: (r["status"], r["round"]) for r in batch.collect() if r["booking_id"] in want} == {b: w[:2] for b, w in want.items()}


def test_late_replies_count_until_the_watermark_and_finished_bookings_leave_the_state(spark, tmp_path):
    src, out, mark = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "mark")

    def run(rows, **more):
        progress = []
        spark.createDataFrame(rows, STATES).coalesce(1).write.mode("append").parquet(src)
        got = SB.run_negotiation(spark, src, STATES, out, mark, files_per_batch=1, delay="60 seconds", progress=progress, buckets=4, **more)
        return {r["booking_id"]: (r["status"], r["round"]) for r in got.collect()}, state_rows(progress)[-1]

    sent = ("sent", 3, -1)
    got, rows = run([(1, *sent, 50, "unavailable", at(50)), (2, *sent, 60, "confirmed", at(60)), (3, *sent, 61, "unclear", at(61))], closed_days=0)
    assert got == {1: ("failed", 3), 2: ("booked", 3), 3: ("sent", 3)}
    got, _ = run([(1, *sent, 40, "confirmed", at(40))], closed_days=0)  # late, of a lower id: it had come first
    assert got[1] == ("booked", 3)
    # both ends are certain once the watermark has passed them; booking 3 stays
    got, _ = run([(3, *sent, 500, "unclear", at(500))], closed_days=0)
    got, rows = run([(3, *sent, 510, "unclear", at(510))], closed_days=0)
    value_rows_of_one_booking = rows
    assert got == {1: ("booked", 3), 2: ("booked", 3), 3: ("sent", 3)} and value_rows_of_one_booking == 1
    # beyond the watermark, and after the end: neither changes anything
    got, _ = run([(2, *sent, 10, "unavailable", at(10)), (2, *sent, 520, "unavailable", at(520))], closed_days=0)
    assert got == {1: ("booked", 3), 2: ("booked", 3), 3: ("sent", 3)}

