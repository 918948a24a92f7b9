"""Routing of advisory questions to reply templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motoquant.config import DEFAULT, Rules
from motoquant.functions.numeric import _c
from motoquant.functions.vocab import any_of

# Wording that decides the kind of a question, and the fixed replies.
ADVISORY_TERMS = [
    "advisory", "car", "cost", "graph", "mean", "fix", "repair", "recommend", "recommendation",
    "sell", "trade", "trade-in", "trade in", "value", "worth",
]
SELL_TERMS = ["sell", "trade in", "trade", "recommend", "recommendation"]
THANKS = r"\bthanks\b|\bthank\s+you\b"
GREETING = r"\bhi\b|\bhello\b"
ACKNOWLEDGEMENT = r"\bok\b|\bokay\b|\bgot\s+it\b"
FOLLOW_UP = r"\bwhy\b|\bexplain\b|\bexplain\s+again\b|\bwhat\s+do\s+you\s+mean\b"
OUTSIDE_REPLY = "I can only help explain this repair versus trade-in advisory right now."
GREETING_REPLY = "Hi, what can I help?"
FILLER = "let me think for a moment"
FILLER_REPLY = "Let me think for a moment."


def normalise_question(text: Column | str) -> Column:
    t = F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def question_kind(text: Column | str, rules: Rules = DEFAULT) -> Column:
    """thanks, greeting, filler, acknowledgement, follow_up, sell, outside or advice."""
    n = normalise_question(text)
    low = F.lower(F.trim(_c(text)))
    advisory = any_of([low.contains(w) for w in ADVISORY_TERMS])
    return (
        F.when(n == "", F.when(advisory, "advice").otherwise("outside"))
        .when(n == f"hey {rules.assistant_name}", "greeting")
        .when(n == FILLER, "filler")
        .when(n.rlike(THANKS), "thanks")
        .when(n.rlike(GREETING), "greeting")
        .when(n.rlike(ACKNOWLEDGEMENT), "acknowledgement")
        .when(n.rlike(FOLLOW_UP), "follow_up")
        .when(any_of([n.contains(w) for w in SELL_TERMS]), "sell")
        .when(~advisory, "outside")
        .otherwise("advice")
    )


def _rm(c: str) -> Column:
    return F.concat(F.lit("RM"), F.format_number(F.col(c), 0))


def answer_questions(questions: DataFrame, advice: DataFrame, key: str = "profile_id", rules: Rules = DEFAULT) -> DataFrame:
    """Kind and reply text of every question, filled from the advice row of its profile.

    ``questions``: question_id, the key, question. ``advice``: the key, recommendation, summary,
    current_value_rm, estimated_repair_cost_rm, repair_outcome_rm, trade_in_now_rm.
    """
    joined = questions.withColumn("kind", question_kind("question", rules)).join(advice, key, "left")
    again = f"Say Hey {rules.assistant_name} if you want to ask more about the advisory."
    trade = F.col("recommendation") == "trade_in"
    outcome = F.concat(
        F.lit("repairing leaves an outcome of "), _rm("repair_outcome_rm"), F.lit(" compared with "),
        _rm("trade_in_now_rm"), F.lit(" if you trade in now."),
    )
    basis = F.concat(
        F.lit("Based on your current value of "), _rm("current_value_rm"),
        F.lit(" and estimated repair cost of "), _rm("estimated_repair_cost_rm"),
    )
    reason = F.concat(
        F.lit("Trade-in is recommended because the estimated repair cost is "), _rm("estimated_repair_cost_rm"),
        F.lit(", and "), outcome,
    )
    sell = F.concat(basis, F.lit(", trading in is recommended because "), outcome)
    advised = F.concat(
        basis, F.lit(", trading in is recommended because repairing does not recover enough value.")
    )
    kind = F.col("kind")
    reply = (
        F.when(kind == "greeting", GREETING_REPLY).when(kind == "filler", FILLER_REPLY)
        .when(kind == "thanks", f"You're welcome. {again}")
        .when(kind == "acknowledgement", f"Got it. {again}")
        .when(kind == "outside", OUTSIDE_REPLY)
        .when(~F.coalesce(trade, F.lit(False)), F.col("summary"))
        .when(kind == "follow_up", reason).when(kind == "sell", sell).otherwise(advised)
    )
    return joined.select("question_id", key, "kind", reply.alias("reply"))
