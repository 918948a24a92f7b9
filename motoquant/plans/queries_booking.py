"""Queries: telemetry, replies, negotiation, slots, questions, nearest sites (R49, R94-R104)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motoquant.functions.numeric import round_even
from motoquant.operators import answers as A
from motoquant.operators import bookings as B
from motoquant.operators import geo as G
from motoquant.operators import telemetry as TM
from motoquant.plans.sqltext import r_even, rint
from motoquant.plans.standins import SQL, _pick, ctes, frame
from motoquant.sources.tables import shared_dir
from motoquant.streaming import bookings as SB
from motoquant.streaming import telemetry as ST

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# --- nearest sites ---------------------------------------------------------------------------

SQL["vehicle_place"] = """SELECT c.c_custkey AS vehicle_id, CAST(c.c_custkey * 37 % 6000 AS DOUBLE) / CAST(1000 AS DOUBLE) + 1 AS lat,
  CAST(c.c_custkey * 53 % 9000 AS DOUBLE) / CAST(1000 AS DOUBLE) + 100 AS lng FROM {customer} c"""
SQL["site_place"] = """SELECT s.s_suppkey AS site_id, CAST(s.s_suppkey * 71 % 6000 AS DOUBLE) / CAST(1000 AS DOUBLE) + 1 AS lat,
  CAST(s.s_suppkey * 97 % 9000 AS DOUBLE) / CAST(1000 AS DOUBLE) + 100 AS lng FROM {supplier} s"""
QUERIES["r49_nearest_sites"] = lambda s, d: G.nearest_sites(
    frame(s, d, "vehicle_place"), frame(s, d, "site_place"), k=4
).select(
    "vehicle_id", "rank", "site_id", round_even("distance_km", 5).alias("distance_km"),
    round_even("map_x", 5).alias("map_x"), round_even("map_y", 5).alias("map_y"),
)
ORACLES["r49_nearest_sites"] = f"""{ctes('vehicle_place', 'site_place')}, b AS (SELECT min(lat) AS la0, max(lat) AS la1, min(lng) AS ln0, max(lng) AS ln1 FROM site_place),
d AS (SELECT v.vehicle_id, s.site_id, v.lat AS vlat, v.lng AS vlng, s.lat, s.lng, 2 * 6371 * asin(sqrt(pow(sin(radians(s.lat - v.lat) / 2), 2)
  + cos(radians(v.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - v.lng) / 2), 2))) AS km FROM vehicle_place v, site_place s),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vehicle_id ORDER BY km, site_id) AS INTEGER) AS rank FROM d)
SELECT vehicle_id, rank, site_id, {r_even('km', 5)} AS distance_km,
  {r_even('12 + (lng - least(ln0, vlng)) / (greatest(ln1, vlng) - least(ln0, vlng)) * 76', 5)} AS map_x,
  {r_even('88 - (lat - least(la0, vlat)) / (greatest(la1, vlat) - least(la0, vlat)) * 76', 5)} AS map_y FROM r, b WHERE rank <= 4"""

# --- telemetry -------------------------------------------------------------------------------

SQL["telemetry_fields"] = """SELECT e.event_id, e.user_id AS vehicle_id, 700 + e.event_id % 2900 AS rpm,
  CAST(700 + e.event_id * 7 % 350 AS DOUBLE) / CAST(10 AS DOUBLE) AS coolant_c,
  CAST(1240 + e.event_id * 11 % 200 AS DOUBLE) / CAST(100 AS DOUBLE) AS battery_v,
  e.user_id * 1500 + e.event_id % 1000 AS odo_km, e.ts, e.event_id % 25 = 0 AS broken FROM {events} e"""
SQL["vehicle_service"] = """SELECT c.c_custkey AS vehicle_id, CAST(c.c_custkey % 9 AS INT) AS services_done,
  CAST(c.c_custkey % 7 AS INT) AS services_due FROM {customer} c"""


def _lines(s: SparkSession, d: str) -> DataFrame:
    """Events as JSON lines, every 25th cut short."""
    t = frame(s, d, "telemetry_fields")
    body = F.to_json(F.struct(
        "vehicle_id", "rpm", "coolant_c", "battery_v", "odo_km",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
    ))
    return t.select(F.when(F.col("broken"), F.substring(body, 1, 20)).otherwise(body).alias("value"))


def _faults(s: SparkSession, d: str) -> DataFrame:
    """Each status that occurs among all orders is a known code."""
    return TM.fault_count(frame(s, d, "orders").select("o_orderstatus").distinct())


def _per_vehicle_faults(s: SparkSession, d: str) -> DataFrame:
    """The statuses among all orders of a customer are the codes of its vehicle."""
    codes = frame(s, d, "orders").select(F.col("o_custkey").alias("vehicle_id"), "o_orderstatus").distinct()
    return TM.fault_count_per(codes, "vehicle_id")


def _score_sql(faults: str) -> str:
    return f"""CAST({rint(f'''least(greatest(100 - (1 - least(1, services_done / CAST(greatest(1, services_due) AS DOUBLE))) * 20
  - least(25, ({faults}) * 8) - least(12, greatest(0, (odo_km - 100000) / CAST(10000 AS DOUBLE)))
  - CASE WHEN battery_v < 12.6 THEN 12 WHEN battery_v < 13.0 THEN 6 ELSE 0 END
  - CASE WHEN coolant_c > 100 THEN 12 WHEN coolant_c > 95 THEN 5 WHEN coolant_c < 75 THEN 4 ELSE 0 END, 0), 100)''')} AS BIGINT)"""


TEL = ctes("telemetry_fields", "vehicle_service")
OUT = "t.vehicle_id, rpm, coolant_c, battery_v, odo_km, ts"
SERVICED = """telemetry_fields t LEFT JOIN (SELECT vehicle_id AS v, services_done AS sd, services_due AS su FROM vehicle_service) ON v = vehicle_id"""
SCORED = f"""SELECT {OUT}, {_score_sql('SELECT count(DISTINCT o_orderstatus) FROM orders')} AS health
FROM (SELECT t.*, coalesce(sd, 0) AS services_done, coalesce(su, 0) AS services_due FROM {SERVICED}) t WHERE NOT broken"""

QUERIES["r94_health_score"] = lambda s, d: TM.score_snapshots(
    TM.parse_snapshots(_lines(s, d)), frame(s, d, "vehicle_service"), _faults(s, d)
)
ORACLES["r94_health_score"] = f"{TEL} {SCORED}"
QUERIES["r97_fault_count"] = lambda s, d: TM.score_snapshots(
    TM.parse_snapshots(_lines(s, d)), frame(s, d, "vehicle_service"), _per_vehicle_faults(s, d)
).select("vehicle_id", "ts", "health")
ORACLES["r97_fault_count"] = f"""{TEL}, f AS (SELECT o_custkey AS c, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1)
SELECT vehicle_id, ts, {_score_sql('coalesce(n, 0)')} AS health FROM (SELECT t.*, coalesce(sd, 0) AS services_done, coalesce(su, 0) AS services_due, f.n
  FROM {SERVICED} LEFT JOIN f ON f.c = t.vehicle_id) WHERE NOT broken"""
QUERIES["r96_latest_snapshot"] = lambda s, d: TM.latest_snapshot(TM.parse_snapshots(_lines(s, d)))
LATEST = """SELECT vehicle_id, rpm, coolant_c, battery_v, odo_km, ts FROM (SELECT *, row_number() OVER
  (PARTITION BY vehicle_id ORDER BY ts DESC, rpm DESC) AS rn FROM telemetry_fields WHERE NOT broken) WHERE rn = 1"""
ORACLES["r96_latest_snapshot"] = f"{TEL} {LATEST}"


def _event_files(s: SparkSession, d: str) -> str:
    path = shared_dir(s, "events")
    _lines(s, d).repartition(8).write.mode("overwrite").text(path)
    return path


def _scored_stream(s: SparkSession, d: str) -> DataFrame:
    out, mark = shared_dir(s, "scored"), shared_dir(s, "scored-offsets")
    stream = ST.scored_stream(s, _event_files(s, d), frame(s, d, "vehicle_service"), _faults(s, d), files_per_batch=3)
    ST.append_to_table(stream, out, mark)
    return s.read.schema(stream.schema).parquet(out)


def _latest_stream(s: SparkSession, d: str) -> DataFrame:
    out, mark = shared_dir(s, "latest"), shared_dir(s, "latest-offsets")
    stream = TM.parse_snapshots(ST.event_lines(s, _event_files(s, d), files_per_batch=3))
    ST.keep_latest(stream, out, mark)
    return ST.read_latest(s, out)


QUERIES["r95_scored_stream"] = _scored_stream
ORACLES["r95_scored_stream"] = f"{TEL} {SCORED}"
QUERIES["r96_latest_stream"] = _latest_stream
ORACLES["r96_latest_stream"] = f"{TEL} {LATEST}"

# --- replies and negotiation -----------------------------------------------------------------

OPENERS = "CONFIRM |That slot is taken. |Maybe later |Yes, that works! |can not do |OK, book it |Fully booked "
SQL["booking"] = f"""SELECT o.o_orderkey AS booking_id, 'cal' || CAST(o.o_custkey % 40 AS STRING) AS calendar_id,
  'chat' || CAST(o.o_orderkey % 500 AS STRING) || CASE WHEN o.o_orderkey % 10 = 0 THEN '-' || CAST(o.o_orderkey AS STRING) ELSE '' END AS chat_id,
  {_pick('sent|sent|sent|booked|confirmed|sent|failed', 'o.o_custkey')} AS status,
  'm' || CAST(o.o_orderkey AS STRING) AS message_id,
  CASE WHEN o.o_orderkey % 3 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(o.o_orderkey % 40 AS BIGINT) END AS update_id,
  CAST(o.o_orderkey % 4 AS INT) AS round, o.o_orderdate AS updated_at, o.o_orderdate AS base_at
FROM {{orders}} o"""
SQL["reply"] = f"""SELECT l.l_partkey * 100 + l.l_suppkey % 100 AS update_id,
  'chat' || CAST(l.l_orderkey % 500 AS STRING) || CASE WHEN l.l_orderkey % 10 = 0 THEN '-' || CAST(l.l_orderkey AS STRING) ELSE '' END AS chat_id,
  CASE WHEN l.l_linenumber % 3 = 0 THEN 'm' || CAST(l.l_orderkey AS STRING) END AS reply_to_message_id,
  CASE WHEN l.l_linenumber = 7 THEN '  ' ELSE {_pick(OPENERS, 'l.l_partkey')}
    || CASE WHEN l.l_linenumber % 2 = 0 THEN 'for bkg-' || CAST(l.l_orderkey AS STRING) ELSE 'thank you' END END AS text,
  l.l_shipdate AS ts FROM {{lineitem}} l"""

QUERIES["r98_match_replies"] = lambda s, d: B.match_replies(frame(s, d, "booking"), frame(s, d, "reply")).select(
    "booking_id", "update_id", "text", "intent"
)
INTENT = r"""CASE WHEN regexp_matches(lower(text), 'not available|no slot|fully booked|another time|different time|can not')
   OR list_has_any(regexp_extract_all(replace(lower(text), '''', ''), '[a-z]+'), ['unavailable', 'taken', 'full', 'busy', 'cannot', 'cant', 'reschedule', 'unfortunately', 'no']) THEN 'unavailable'
 WHEN list_has_any(regexp_extract_all(replace(lower(text), '''', ''), '[a-z]+'), ['confirm', 'confirmed', 'yes', 'ok', 'okay', 'approved', 'available', 'book', 'booked', 'sure', 'great']) THEN 'confirmed'
 ELSE 'unclear' END"""
ORACLES["r98_match_replies"] = f"""{ctes('booking', 'reply')}, w AS (SELECT *, count(*) OVER (PARTITION BY chat_id) = 1 AS alone FROM booking WHERE status = 'sent'),
m AS (SELECT w.booking_id, r.update_id, r.text, r.ts FROM w JOIN reply r ON r.chat_id = w.chat_id AND trim(r.text) <> '' AND r.ts >= w.updated_at
  AND (contains(lower(r.text), 'bkg-' || CAST(w.booking_id AS VARCHAR)) OR r.reply_to_message_id = w.message_id OR w.alone)
  AND (NOT w.alone OR w.update_id IS NULL OR r.update_id > w.update_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY ts DESC, update_id DESC, text DESC) AS rn FROM m)
SELECT booking_id, update_id, text, {INTENT} AS intent FROM k WHERE rn = 1"""

QUERIES["r99_processed_offset"] = lambda s, d: B.processed_offset(
    frame(s, d, "booking"), B.match_replies(frame(s, d, "booking"), frame(s, d, "reply"))
).select("booking_id", "update_id")
ORACLES["r99_processed_offset"] = ORACLES["r98_match_replies"].replace(
    f"SELECT booking_id, update_id, text, {INTENT} AS intent FROM k WHERE rn = 1",
    "SELECT b.booking_id, greatest(b.update_id, k.update_id) AS update_id FROM booking b LEFT JOIN (SELECT * FROM k WHERE rn = 1) k ON b.booking_id = k.booking_id",
)

SQL["reply_text"] = f"""SELECT c.conv_id, c.turn, {_pick(OPENERS, 'c.conv_id + c.turn')} || c.text AS text FROM {{conversations}} c"""
QUERIES["r100_reply_intent"] = lambda s, d: frame(s, d, "reply_text").select("conv_id", "turn", B.reply_intent("text").alias("intent"))
ORACLES["r100_reply_intent"] = f"{ctes('reply_text')} SELECT conv_id, turn, {INTENT} AS intent FROM reply_text"

SQL["booking_event"] = f"""SELECT l.l_orderkey AS booking_id, l.l_partkey * 100 + l.l_suppkey % 100 AS update_id,
  {_pick('unavailable|unclear|unavailable|confirmed|unavailable', 'l.l_partkey + l.l_linenumber')} AS intent FROM {{lineitem}} l"""
SQL["busy_time"] = """SELECT 'cal' || CAST(e.user_id % 40 AS STRING) AS calendar_id, e.ts AS start,
  e.ts + CASE e.event_id % 4 WHEN 0 THEN INTERVAL '30' MINUTE WHEN 1 THEN INTERVAL '2' HOUR WHEN 2 THEN INTERVAL '1' DAY ELSE INTERVAL '5' MINUTE END AS `end`
FROM {events} e"""
SQL["slot_request"] = """SELECT o.o_orderkey AS booking_id, 'cal' || CAST(o.o_custkey % 40 AS STRING) AS calendar_id,
  CAST(CASE o.o_orderkey % 3 WHEN 0 THEN '2024-01-0' ELSE '2024-01-1' END || CAST(o.o_custkey % 9 + 1 AS STRING) || ' '
    || CASE o.o_orderkey % 4 WHEN 0 THEN '10:00:00' WHEN 1 THEN '16:00:00' WHEN 2 THEN '22:30:00' ELSE '03:00:00' END AS TIMESTAMP) AS slot_at
FROM {orders} o"""


def _requests(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "slot_request").withColumn("slot_at", F.col("slot_at").cast("timestamp_ntz"))


def _days(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "events").select(
        F.concat(F.lit("cal"), F.col("user_id") % 40).alias("calendar_id"), F.col("ts").cast("date").alias("day")
    ).distinct()


QUERIES["r102_free_slots"] = lambda s, d: B.free_slots(_days(s, d), frame(s, d, "busy_time")).select(
    "calendar_id", F.col("day").cast("string").alias("day"), "slot"
)
BUSY = ctes("busy_time")
ORACLES["r102_free_slots"] = f"""{BUSY}, d AS (SELECT DISTINCT 'cal' || CAST(user_id % 40 AS VARCHAR) AS calendar_id, CAST(ts AS DATE) AS day FROM events),
c AS (SELECT calendar_id, day, h, CAST(day AS TIMESTAMP) + to_hours(h) AS s FROM d, range(9, 18) t(h))
SELECT calendar_id, CAST(day AS VARCHAR) AS day, lpad(CAST(h AS VARCHAR), 2, '0') || ':00' AS slot FROM c
WHERE NOT EXISTS (SELECT 1 FROM busy_time b WHERE b.calendar_id = c.calendar_id AND b.start < c.s + INTERVAL 1 HOUR AND c.s < b."end")"""

QUERIES["r103_next_free_slot"] = lambda s, d: B.next_free_slot(_requests(s, d), frame(s, d, "busy_time"))
NEXT = """, keys AS (SELECT DISTINCT calendar_id, slot_at FROM slot_request),
c AS (SELECT k.calendar_id, k.slot_at, CAST(CAST(k.slot_at AS DATE) AS TIMESTAMP) + to_hours(n * 24 + h) AS s FROM keys k, range(14) a(n), range(9, 18) t(h)),
f AS (SELECT calendar_id, slot_at, min(s) AS free FROM c WHERE s > slot_at AND NOT EXISTS
  (SELECT 1 FROM busy_time b WHERE b.calendar_id = c.calendar_id AND b.start < c.s + INTERVAL 1 HOUR AND c.s < b."end") GROUP BY 1, 2)"""
ORACLES["r103_next_free_slot"] = f"""{ctes('slot_request', 'busy_time')}{NEXT}
SELECT r.booking_id, r.calendar_id, r.slot_at, coalesce(f.free, CASE
  WHEN hour(r.slot_at + INTERVAL 1 HOUR) < 9 THEN date_trunc('day', r.slot_at + INTERVAL 1 HOUR) + INTERVAL 9 HOUR
  WHEN hour(r.slot_at + INTERVAL 1 HOUR) >= 18 THEN date_trunc('day', r.slot_at + INTERVAL 1 HOUR) + INTERVAL 33 HOUR
  ELSE r.slot_at + INTERVAL 1 HOUR END) AS next_slot
FROM slot_request r LEFT JOIN f ON f.calendar_id = r.calendar_id AND f.slot_at = r.slot_at"""


def _bookings(s: SparkSession, d: str) -> DataFrame:
    slots = _requests(s, d).select("booking_id", "slot_at")
    return frame(s, d, "booking").select("booking_id", "calendar_id", "status", "round", "update_id").join(slots, "booking_id")


QUERIES["r101_negotiation"] = lambda s, d: B.negotiate(
    _bookings(s, d), frame(s, d, "booking_event"), frame(s, d, "busy_time")
).select("booking_id", "status", "round", "update_id", "slot_at")
# the comparison walks the replies one by one with a recursive query
STATE = f"""{ctes('booking', 'booking_event', 'slot_request', 'busy_time').replace('WITH ', 'WITH RECURSIVE ', 1)},
ev AS (SELECT e.*, row_number() OVER (PARTITION BY e.booking_id ORDER BY e.update_id) AS i
  FROM (SELECT DISTINCT booking_id, update_id, intent FROM booking_event) e JOIN booking b ON b.booking_id = e.booking_id AND b.status = 'sent'
  WHERE b.update_id IS NULL OR e.update_id > b.update_id),
walk(booking_id, i, status, round, moves, update_id) AS (
  SELECT booking_id, CAST(0 AS BIGINT), CASE status WHEN 'confirmed' THEN 'booked' ELSE status END, round, 0, update_id FROM booking
  UNION ALL
  SELECT w.booking_id, ev.i, CASE WHEN ev.intent = 'confirmed' THEN 'booked' WHEN ev.intent = 'unavailable' AND w.round >= 3 THEN 'failed' ELSE 'sent' END,
    CASE WHEN ev.intent = 'unavailable' AND w.round < 3 THEN w.round + 1 ELSE w.round END,
    CASE WHEN ev.intent = 'unavailable' AND w.round < 3 THEN w.moves + 1 ELSE w.moves END, ev.update_id
  FROM walk w JOIN ev ON ev.booking_id = w.booking_id AND ev.i = w.i + 1 WHERE w.status = 'sent'),
final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY i DESC) AS rn FROM walk) WHERE rn = 1)"""


ROLLED = """CASE WHEN hour(p.slot_at + INTERVAL 1 HOUR) < 9 THEN date_trunc('day', p.slot_at + INTERVAL 1 HOUR) + INTERVAL 9 HOUR
  WHEN hour(p.slot_at + INTERVAL 1 HOUR) >= 18 THEN date_trunc('day', p.slot_at + INTERVAL 1 HOUR) + INTERVAL 33 HOUR
  ELSE p.slot_at + INTERVAL 1 HOUR END"""


def _hop(src: str, dst: str, n: int) -> str:
    """Slot after the n-th move."""
    return f""", k{n} AS (SELECT DISTINCT calendar_id, slot_at FROM {src}),
c{n} AS (SELECT k.calendar_id, k.slot_at, CAST(CAST(k.slot_at AS DATE) AS TIMESTAMP) + to_hours(n * 24 + h) AS s FROM k{n} k, range(14) a(n), range(9, 18) t(h)),
f{n} AS (SELECT calendar_id, slot_at, min(s) AS free FROM c{n} c WHERE s > slot_at AND NOT EXISTS
  (SELECT 1 FROM busy_time b WHERE b.calendar_id = c.calendar_id AND b.start < c.s + INTERVAL 1 HOUR AND c.s < b."end") GROUP BY 1, 2),
{dst} AS (SELECT p.* REPLACE (CASE WHEN p.moves >= {n} THEN coalesce(f.free, {ROLLED}) ELSE p.slot_at END AS slot_at) FROM {src} p
  LEFT JOIN f{n} f ON f.calendar_id = p.calendar_id AND f.slot_at = p.slot_at)"""


ORACLES["r101_negotiation"] = f"""{STATE}, p0 AS (SELECT f.booking_id, f.status, f.round, f.moves, f.update_id, b.calendar_id, r.slot_at FROM final f
  JOIN booking b ON b.booking_id = f.booking_id JOIN slot_request r ON r.booking_id = f.booking_id)
{_hop('p0', 'p1', 1)}{_hop('p1', 'p2', 2)}{_hop('p2', 'p3', 3)}
SELECT booking_id, status, round, update_id, slot_at FROM p3"""


ARRIVALS = 2  # parts in which the replies reach the stream


def _negotiation_stream(s: SparkSession, d: str) -> DataFrame:
    """The same state from the keyed stream, with replies out of order.

    Event time follows the update id. A reply arrives with its own part of the time or, by hash, with
    the next one, so every part but the first holds replies older than some that were read before.
    """
    known = frame(s, d, "booking").select(
        "booking_id", "status", "round", F.coalesce("update_id", F.lit(-1)).alias("last_update_id")
    )
    events = frame(s, d, "booking_event").join(known, "booking_id").withColumn("ts", F.timestamp_seconds(F.col("update_id") + 1_700_000_000))
    src = shared_dir(s, "booking-events")
    length = (frame(s, d, "booking_event").agg(F.max("update_id")).first()[0] or 0) // ARRIVALS + 1
    late = F.pmod(F.xxhash64("booking_id", "update_id"), F.lit(2))
    part = F.floor(F.col("update_id") / length) + late
    for i in range(ARRIVALS + 1):
        events.filter(part == i).repartition(4, "booking_id").write.mode("append").parquet(src)
    done = SB.run_negotiation(
        s, src, events.schema, shared_dir(s, "booking-state"), shared_dir(s, "booking-offsets"), files_per_batch=4, bookings=known,
        delay=f"{3 * length} seconds",
    )
    return done.select("booking_id", "status", "round", "moves")


QUERIES["r101_negotiation_stream"] = _negotiation_stream
ORACLES["r101_negotiation_stream"] = f"""{STATE} SELECT booking_id, status, CAST(round AS INTEGER) AS round, CAST(moves AS INTEGER) AS moves FROM final"""

# --- questions -------------------------------------------------------------------------------

ASKED = "Hey advisor!|Thanks a lot |hi there |Got it, |Why? |Should I sell |what is my car worth |tell me a joke |Let me think for a moment.|"
SQL["question"] = f"""SELECT c.conv_id * 100 + c.turn AS question_id, c.conv_id % 50 AS profile_id,
  coalesce({_pick(ASKED, 'c.conv_id + c.turn')}, '') || CASE WHEN (c.conv_id + c.turn) % 10 IN (0, 8) THEN '' ELSE c.text END AS question FROM {{conversations}} c"""
SQL["advice"] = """SELECT o.o_orderkey AS profile_id, CASE WHEN o.o_orderkey % 2 = 0 THEN 'trade_in' ELSE 'repair' END AS recommendation,
  'Summary ' || CAST(o.o_orderkey AS STRING) AS summary, CAST(floor(o.o_totalprice) AS BIGINT) AS current_value_rm,
  18400 + o.o_orderkey AS estimated_repair_cost_rm, CAST(floor(o.o_totalprice / 2) AS BIGINT) AS repair_outcome_rm,
  CAST(floor(o.o_totalprice * 2) AS BIGINT) AS trade_in_now_rm FROM {orders} o"""
QUERIES["r104_answers"] = lambda s, d: A.answer_questions(frame(s, d, "question"), frame(s, d, "advice"))
_N = r"trim(regexp_replace(regexp_replace(lower(question), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_ADV = "regexp_matches(lower(question), 'advisory|car|cost|graph|mean|fix|repair|recommend|sell|trade|value|worth')"
_RM = lambda c: f"'RM' || format('{{:,}}', {c})"
_OUTCOME = f"'repairing leaves an outcome of ' || {_RM('repair_outcome_rm')} || ' compared with ' || {_RM('trade_in_now_rm')} || ' if you trade in now.'"
_BASIS = f"'Based on your current value of ' || {_RM('current_value_rm')} || ' and estimated repair cost of ' || {_RM('estimated_repair_cost_rm')}"
ORACLES["r104_answers"] = f"""{ctes('question', 'advice')}, n AS (SELECT *, {_N} AS n FROM question),
k AS (SELECT *, CASE WHEN n = '' THEN CASE WHEN {_ADV} THEN 'advice' ELSE 'outside' END WHEN n = 'hey advisor' THEN 'greeting'
  WHEN n = 'let me think for a moment' THEN 'filler' WHEN regexp_matches(n, '\\bthanks\\b|\\bthank you\\b') THEN 'thanks'
  WHEN regexp_matches(n, '\\b(hi|hello)\\b') THEN 'greeting' WHEN regexp_matches(n, '\\b(ok|okay|got it)\\b') THEN 'acknowledgement'
  WHEN regexp_matches(n, '\\b(why|explain|what do you mean)\\b') THEN 'follow_up' WHEN regexp_matches(n, 'sell|trade|recommend') THEN 'sell'
  WHEN NOT {_ADV} THEN 'outside' ELSE 'advice' END AS kind FROM n)
SELECT k.question_id, k.profile_id, kind, CASE kind WHEN 'greeting' THEN 'Hi, what can I help?' WHEN 'filler' THEN 'Let me think for a moment.'
  WHEN 'thanks' THEN 'You''re welcome. Say Hey advisor if you want to ask more about the advisory.'
  WHEN 'acknowledgement' THEN 'Got it. Say Hey advisor if you want to ask more about the advisory.'
  WHEN 'outside' THEN 'I can only help explain this repair versus trade-in advisory right now.'
  ELSE CASE WHEN recommendation <> 'trade_in' THEN summary
    WHEN kind = 'follow_up' THEN 'Trade-in is recommended because the estimated repair cost is ' || {_RM('estimated_repair_cost_rm')} || ', and ' || {_OUTCOME}
    WHEN kind = 'sell' THEN {_BASIS} || ', trading in is recommended because ' || {_OUTCOME}
    ELSE {_BASIS} || ', trading in is recommended because repairing does not recover enough value.' END END AS reply
FROM k LEFT JOIN advice a ON a.profile_id = k.profile_id"""
