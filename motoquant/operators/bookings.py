"""Booking replies: matching, intent, negotiation outcome, and free calendar slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motoquant.config import DEFAULT, Rules
from motoquant.functions.numeric import _c

# Wording of a reply.
REFUSAL_PHRASES = ["not available", "no slot", "fully booked", "another time", "different time", "can not"]
REFUSAL_WORDS = ["unavailable", "taken", "full", "busy", "cannot", "cant", "reschedule", "unfortunately", "no"]
CONSENT_WORDS = [
    "confirm", "confirmed", "yes", "ok", "okay", "approved", "available", "book", "booked", "sure", "great",
]
TERMINAL = ["booked", "failed", "dry_run"]


def reply_intent(text: Column | str) -> Column:
    """confirmed, unavailable or unclear; refusal outweighs consent."""
    t = F.lower(F.trim(_c(text)))
    words = F.regexp_extract_all(F.replace(t, F.lit("'"), F.lit("")), F.lit("([a-z]+)"), 1)
    refused = F.lit(False)
    for p in REFUSAL_PHRASES:
        refused = refused | t.contains(p)
    has = lambda listed: F.arrays_overlap(words, F.array(*[F.lit(w) for w in listed]))
    return (
        F.when(refused | has(REFUSAL_WORDS), "unavailable").when(has(CONSENT_WORDS), "confirmed").otherwise("unclear")
    )


def match_replies(bookings: DataFrame, replies: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """The newest reply that belongs to each waiting booking.

    A reply belongs if its text holds the booking's reference, if it threads to the booking's
    message, or if its chat has no other waiting booking. Each of the three is an equi-join: the
    references inside a text are cut out (with every prefix of their digits, as a longer number
    contains the shorter reference too), so no text is compared with every booking.

    ``bookings``: booking_id, chat_id, status, message_id, update_id, updated_at.
    ``replies``: update_id, chat_id, reply_to_message_id, text, ts.
    """
    waiting = bookings.filter(F.col("status") == "sent").select(
        "booking_id", "chat_id", "message_id",
        F.col("update_id").alias("_last"), F.date_trunc("second", "updated_at").alias("_since"),
    )
    alone = waiting.groupBy("chat_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(
        F.col("chat_id"), F.lit(True).alias("_alone")
    )
    waiting = waiting.join(alone, "chat_id", "left").withColumn("_alone", F.coalesce("_alone", F.lit(False)))
    usable = replies.filter(F.trim("text") != "").withColumn("_ts", F.date_trunc("second", "ts"))

    mark = rules.booking_prefix.lower()
    numbers = F.regexp_extract_all(F.lower("text"), F.lit(rf"{mark}(\d+)"), 1)
    prefixes = F.array_distinct(F.flatten(F.transform(
        numbers, lambda d: F.transform(F.sequence(F.lit(1), F.length(d)), lambda n: F.substring(d, F.lit(1), n))
    )))
    by_reference = usable.withColumn("_ref", F.explode(prefixes)).join(
        waiting.withColumn("_ref", F.col("booking_id").cast("string")), ["chat_id", "_ref"]
    ).drop("_ref")
    by_thread = usable.join(waiting, (usable.chat_id == waiting.chat_id) & (F.col("reply_to_message_id") == F.col("message_id"))).drop(waiting.chat_id)
    by_chat = usable.join(waiting.filter("_alone"), "chat_id")
    columns = ["booking_id", "update_id", "text", "ts", "_ts", "_since", "_last", "_alone"]
    matched = (
        by_reference.select(columns).unionByName(by_thread.select(columns)).unionByName(by_chat.select(columns))
        .filter(F.col("_ts") >= F.col("_since"))
        .filter(~F.col("_alone") | F.col("_last").isNull() | (F.col("update_id") > F.col("_last")))
    )
    newest = matched.groupBy("booking_id").agg(F.max(F.struct("_ts", "update_id", "text", "ts")).alias("r"))
    return newest.select("booking_id", "r.update_id", "r.text", "r.ts", reply_intent("r.text").alias("intent"))


def processed_offset(bookings: DataFrame, matches: DataFrame) -> DataFrame:
    """Bookings with the highest update id seen; it never moves back."""
    seen = matches.groupBy("booking_id").agg(F.max("update_id").alias("_seen"))
    return bookings.join(seen, "booking_id", "left").withColumn(
        "update_id", F.greatest("update_id", "_seen")
    ).drop("_seen")


# --- slots -----------------------------------------------------------------------------------


def _work_hours(rules: Rules) -> Column:
    return F.sequence(F.lit(rules.work_start_hour), F.lit(rules.work_end_hour - 1))


def _at(day: Column, hour: Column) -> Column:
    return (day.cast("timestamp_ntz") + F.make_dt_interval(hours=hour)).cast("timestamp_ntz")


def busy_slots(busy: DataFrame, first_day: Column, last_day: Column) -> DataFrame:
    """Distinct hour slots (calendar_id, slot_start) that a busy interval overlaps.

    Overlap of half-open intervals becomes an equi-join key: the hours an interval touches. Long
    intervals are clipped to the days asked about.
    """
    s = F.greatest(F.col("start"), first_day.cast("timestamp_ntz"))
    e = F.least(F.col("end"), F.date_add(last_day, 1).cast("timestamp_ntz"))
    first = F.date_trunc("hour", s).cast("timestamp_ntz")
    last = F.date_trunc("hour", e - F.expr("INTERVAL 1 MICROSECOND")).cast("timestamp_ntz")
    clipped = busy.withColumn("_first", first).withColumn("_last", last).filter(F.col("_first") <= F.col("_last"))
    return clipped.select(
        "calendar_id", F.explode(F.sequence("_first", "_last", F.expr("INTERVAL 1 HOUR"))).alias("slot_start")
    ).distinct()


def free_slots(days: DataFrame, busy: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Working-hour slots of each (calendar_id, day) that no busy interval overlaps."""
    span = days.agg(F.min("day").alias("_d0"), F.max("day").alias("_d1"))
    slots = days.distinct().withColumn("hour", F.explode(_work_hours(rules))).withColumn(
        "slot_start", _at(F.col("day"), F.col("hour"))
    )
    taken = busy_slots(busy.join(F.broadcast(span)), F.col("_d0"), F.col("_d1"))
    return slots.join(taken, ["calendar_id", "slot_start"], "left_anti").select(
        "calendar_id", "day", F.format_string("%02d:00", F.col("hour")).alias("slot"), "slot_start"
    )


def _rolled(current: Column, rules: Rules) -> Column:
    """One hour later, moved into working hours."""
    next_ = current + F.expr("INTERVAL 1 HOUR")
    midnight = F.date_trunc("day", next_).cast("timestamp_ntz")
    early = midnight + F.make_dt_interval(hours=F.lit(rules.work_start_hour))
    late = midnight + F.make_dt_interval(hours=F.lit(24 + rules.work_start_hour))
    return (
        F.when(F.hour(next_) < rules.work_start_hour, early)
        .when(F.hour(next_) >= rules.work_end_hour, late)
        .otherwise(next_).cast("timestamp_ntz")
    )


def slot_hops(keys: DataFrame, busy: DataFrame, hops: int, rules: Rules = DEFAULT) -> DataFrame:
    """The next ``hops`` slots after each (calendar_id, start_at), as columns hop_1, hop_2, ...

    Each hop expands a key to its fixed number of candidate slots, marks the taken ones and folds
    back to one row, so the hops form a chain and no step is computed twice.
    """
    span = keys.agg(
        F.min(F.col("start_at").cast("date")).alias("_d0"),
        F.date_add(F.max(F.col("start_at").cast("date")), rules.search_days * hops + hops).alias("_d1"),
    )
    taken = busy_slots(busy.join(F.broadcast(span)), F.col("_d0"), F.col("_d1")).withColumn("_taken", F.lit(True))
    out = keys.select("calendar_id", "start_at").distinct().withColumn("_at", F.col("start_at"))
    names: list[str] = []
    for i in range(1, hops + 1):
        fixed = ["calendar_id", "start_at", "_at", *names]
        slot = _at(F.date_add(F.col("_at").cast("date"), F.col("_n")), F.col("_h"))
        candidates = (
            out.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(rules.search_days - 1))))
            .withColumn("_h", F.explode(_work_hours(rules)))
            .select(*fixed, slot.alias("slot_start"))
        )
        later = F.when(F.col("_taken").isNull() & (F.col("slot_start") > F.col("_at")), F.col("slot_start"))
        folded = candidates.join(taken, ["calendar_id", "slot_start"], "left").groupBy(*fixed).agg(
            F.min(later).alias("_free")
        )
        names.append(f"hop_{i}")
        out = folded.withColumn(names[-1], F.coalesce("_free", _rolled(F.col("_at"), rules))).select(
            "calendar_id", "start_at", F.col(names[-1]).alias("_at"), *names
        )
    return out.drop("_at")


def next_free_slot(
    wanted: DataFrame, busy: DataFrame, current: str = "slot_at", out: str = "next_slot", rules: Rules = DEFAULT
) -> DataFrame:
    """First free slot strictly after ``current`` within the search days, else one hour on.

    Looked up once per distinct (calendar, moment) and joined back.
    """
    keys = wanted.select("calendar_id", F.col(current).alias("start_at"))
    found = slot_hops(keys, busy, 1, rules).select("calendar_id", F.col("start_at").alias(current), F.col("hop_1").alias(out))
    return wanted.join(found, ["calendar_id", current], "left").select(*[c for c in wanted.columns if c != out], out)


# --- negotiation -----------------------------------------------------------------------------


def negotiate(bookings: DataFrame, replies: DataFrame, busy: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """State of each booking after all its replies, in update order.

    A sent booking ends at its first confirmation or at the refusal that exceeds the allowed
    rounds, whichever comes first; earlier refusals each move it to the next free slot. So only
    the first confirmation and the first few refusals matter: both are found with map-side
    reduction, and a booking with millions of replies costs no more than any other.

    ``bookings``: booking_id, calendar_id, status, slot_at, round, update_id.
    ``replies``: booking_id, update_id, intent.
    """
    b = bookings.withColumn("round", F.coalesce("round", F.lit(0)))
    fresh = replies.join(
        b.filter("status = 'sent'").select("booking_id", F.col("update_id").alias("_from")), "booking_id"
    ).filter(F.col("_from").isNull() | (F.col("update_id") > F.col("_from")))
    confirm = fresh.groupBy("booking_id").agg(
        F.min(F.when(F.col("intent") == "confirmed", F.col("update_id"))).alias("_confirm"),
        F.max("update_id").alias("_seen"),
    )
    order = Window.partitionBy("booking_id").orderBy("update_id")
    refusals = (
        fresh.filter("intent = 'unavailable'").select("booking_id", "update_id").distinct()
        .withColumn("_k", F.row_number().over(order))
        .filter(F.col("_k") <= rules.max_rounds + 1)
        .groupBy("booking_id").agg(F.sort_array(F.collect_list("update_id")).alias("_no"))
    )
    joined = b.join(confirm, "booking_id", "left").join(refusals, "booking_id", "left")
    allowed = F.greatest(F.lit(rules.max_rounds) - F.col("round"), F.lit(0))
    staged = joined.withColumn("_fail", F.get("_no", allowed))
    won = F.col("_confirm").isNotNull() & (F.col("_fail").isNull() | (F.col("_confirm") < F.col("_fail")))
    end = F.when(won, F.col("_confirm")).otherwise(F.col("_fail"))
    moved = F.coalesce(
        F.size(F.filter(F.slice("_no", F.lit(1), allowed), lambda x: end.isNull() | (x < end))), F.lit(0)
    )
    active = F.col("status") == "sent"
    state = staged.select(
        "booking_id", "calendar_id", "slot_at",
        F.when(F.col("status") == "confirmed", "booked").when(~active, F.col("status"))
        .when(won, "booked").when(F.col("_fail").isNotNull(), "failed").otherwise("sent").alias("status"),
        (F.col("round") + F.when(active & F.col("_no").isNotNull(), moved).otherwise(0)).alias("round"),
        F.when(active & F.col("_no").isNotNull(), moved).otherwise(0).alias("_moves"),
        F.greatest("update_id", F.when(active, F.coalesce(end, F.col("_seen")))).alias("update_id"),
    )
    waiting = bookings.filter("status = 'sent'").select("calendar_id", F.col("slot_at").alias("start_at"))
    hops = slot_hops(waiting, busy, rules.max_rounds, rules).withColumnRenamed("start_at", "slot_at")
    slots = F.array("slot_at", *[f"hop_{i}" for i in range(1, rules.max_rounds + 1)])
    return state.join(hops, ["calendar_id", "slot_at"], "left").select(
        "booking_id", "calendar_id", F.get(slots, F.col("_moves")).alias("slot_at"), "status", "round", "update_id"
    )
