"""Quality rules with a hashed n-gram likelihood ratio (operator 1).

Two multinomials over hashed word and punctuation n-grams are counted: one over all documents, one
over trusted documents (labelled quality 1). A document's score is the mean over its n-grams of the
log ratio of both smoothed probabilities. Every document is judged by one threshold, the middle of
the score range that best separates the labelled documents. Base rules reject first.

Both sides and the threshold use all rows. Null texts and texts without words
have score 0 and fail the base rules. Repeated rows are judged once each, a document labelled both
ways counts as not trusted, and without trusted or without rejected labels the threshold is
``LOWEST``: only the base rules reject. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motoquant.llm.store import IDS, settle, table
from motoquant.llm.words import NOT_NEWLINE, NOT_SPACE, annotate, byte_class, chunks, mix, runs_to_mask, split_kinds, split_words, sums, text_buffer, window_hashes
from motoquant.operators.joins import lookup_join

BUCKETS = 1 << 16
ORDERS = (1, 2)
SMOOTHING = 1.0
BINS_PER_UNIT = 100
LOWEST = -50.0

# Fixed values of the base rules.
SYMBOLS = byte_class(lambda b: chr(b) in "#*$%&|<>")
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
_LETTER_STARTS = byte_class(lambda b: b not in (0x20, *range(0x09, 0x0E)) and not 0x80 <= b < 0xC0)


def _repeats(hashes: np.ndarray, text: np.ndarray, keep) -> np.ndarray:
    """Which hashes occur again in their text (``keep=False``: all of them; "first": later ones)."""
    return pd.Series(hashes ^ mix(text.astype(np.uint64) + np.uint64(1))).duplicated(keep=keep).to_numpy()


def base_counts(column) -> dict[str, np.ndarray]:
    raw, offsets = text_buffer(column)
    words = split_words(raw, offsets, NOT_SPACE)
    lines = split_words(raw, offsets, NOT_NEWLINE)
    filled = np.concatenate(([0], np.cumsum(NOT_SPACE[raw])))
    again = _repeats(lines.hashes(1), lines.text, "first") & (filled[lines.ends] > filled[lines.starts])
    at = words.windows(REPEAT_WINDOW)
    grams = window_hashes(words.hashes(), at, REPEAT_WINDOW)
    twice = at[_repeats(grams, words.text[at], False)]
    return {
        "n_words": words.counts,
        "word_chars": sums(_LETTER_STARTS[raw], offsets),
        "n_symbols": sums(SYMBOLS[raw], offsets),
        "n_dup_lines": sums(again, lines.first),
        "n_repeat_words": sums(runs_to_mask(len(words.starts), twice, twice + REPEAT_WINDOW), words.first),
    }


def gram_buckets(column) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of words and punctuation runs, and the text it belongs to."""
    units = split_kinds(*text_buffer(column))
    hashes, text = units.hashes(), units.text
    found, owner = [], []
    for n in ORDERS:
        at = units.windows(n)
        found.append(window_hashes(hashes, at, n) >> np.uint64(64 - BUCKETS.bit_length() + 1))
        owner.append(text[at])
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


@dataclass
class Counts:
    raw: np.ndarray
    trusted: np.ndarray

    def ratios(self) -> np.ndarray:
        """Log of trusted over raw probability, by bucket; all zero where nothing is trusted."""
        if not self.trusted.sum():
            return np.zeros(BUCKETS)
        share = [(c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS) for c in (self.trusted, self.raw)]
        return np.log(share[0]) - np.log(share[1])


def verdicts(labels: DataFrame) -> DataFrame:
    """One row per labelled document: good where every label of it is 1."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))


def count_grams(docs: DataFrame, labels: DataFrame) -> Counts:
    """Both multinomials; the result has a fixed number of buckets."""
    good = verdicts(labels).filter("good")
    rows = lookup_join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), good, "doc_id", rules=IDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for piece in chunks(batches):
            bucket, text = gram_buckets(piece.column("text"))
            inside = piece.column("good").is_valid().to_numpy(zero_copy_only=False)
            raw += np.bincount(bucket, minlength=BUCKETS)
            trusted += np.bincount(bucket[inside[text]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(trusted[at])], ["bucket", "raw", "trusted"])

    parts = rows.select("text", "good").mapInArrow(run, "bucket long, raw long, trusted long")
    total = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas()
    counts = Counts(np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64))
    counts.raw[total["bucket"].to_numpy(np.int64)] = total["raw"].to_numpy(np.int64)
    counts.trusted[total["bucket"].to_numpy(np.int64)] = total["trusted"].to_numpy(np.int64)
    return counts


FIELDS = "_op1 struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, score: double>"


def measure(docs: DataFrame, counts: Counts, keep: list[str]) -> DataFrame:
    """The kept columns and ``_op1``: base counts and score."""
    shared = docs.sparkSession.sparkContext.broadcast(counts.ratios())

    def start():
        ratios = shared.value

        def step(piece: pa.RecordBatch) -> list:
            base = base_counts(piece.column("text"))
            bucket, text = gram_buckets(piece.column("text"))
            total = np.bincount(text, weights=ratios[bucket], minlength=piece.num_rows)
            grams = np.bincount(text, minlength=piece.num_rows)
            score = np.divide(total, grams, out=np.zeros(piece.num_rows), where=grams > 0)
            return [pa.StructArray.from_arrays([*(pa.array(v, pa.int64()) for v in base.values()), pa.array(np.round(score, 9))], [*base, "score"])]

        return step

    return annotate(docs, keep, FIELDS, start)


def base_failed() -> Column:
    words, repeats = F.col("_op1.n_words"), F.col("_op1.n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def find_threshold(measured: DataFrame, labels: DataFrame) -> float:
    """Where labelled documents that pass the base rules separate best by score.

    Scores are counted in bins of fixed width, so the driver gets a bounded table.
    """
    rows = measured.filter(~base_failed()).select("doc_id", F.greatest(F.lit(LOWEST), F.least(F.lit(-LOWEST), "_op1.score")).alias("score"))
    bins = (
        rows.join(verdicts(labels), "doc_id").groupBy(F.floor(F.col("score") * BINS_PER_UNIT).cast("long").alias("bin"))
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toPandas().sort_values("bin")
    )
    good, bad = bins["good"].to_numpy(float), bins["bad"].to_numpy(float)
    if not good.sum() or not bad.sum():
        return LOWEST
    lost = np.concatenate(([0.0], np.cumsum(good))) / good.sum()
    caught = np.concatenate(([0.0], np.cumsum(bad))) / bad.sum()
    edges = np.concatenate((bins["bin"].to_numpy(float), [bins["bin"].max() + 1.0]))
    best = int((caught - lost).argmax())
    below = edges[best - 1] + 1 if best else edges[0] - 1  # the threshold lies between filled bins
    return float((below + edges[best]) / 2 / BINS_PER_UNIT)


def kept(threshold: float) -> Column:
    return ~base_failed() & (F.col("_op1.score") >= threshold)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    measured = settle(measure(docs, count_grams(docs, labels), ["doc_id"]), "quality")
    threshold = find_threshold(measured, labels)
    return measured.select(
        "doc_id", "_op1.n_words", "_op1.word_chars", "_op1.n_symbols", "_op1.n_dup_lines", "_op1.n_repeat_words",
        base_failed().alias("base_failed"), kept(threshold).alias("kept"), "_op1.score",
    )
