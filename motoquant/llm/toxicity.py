"""Toxicity by a factorization machine over hashed terms (operator 5).

Terms of a text are its words and their first bytes, lower-cased and hashed to 64 bits, each counted
once. Of the terms of the training rows, those most associated with either label become features;
Spark ML fits the machine, whose factor vectors weigh pairs of features, on them. A logistic map
fitted on the training margins turns margins into probabilities. All texts are scored whole.

Training takes labelled rows whose crc32 of the id modulo 3 is not 1, at most ``TRAIN_ROWS`` of them,
those of the smallest hash of their id. Labels, language, source and id are no features. Without rows
of both labels every score is the share of toxic rows, 0 if there are none. Null and empty texts are
scored from the intercept. Conflicting labels of one id count as toxic. Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motoquant.llm.store import settle, table
from motoquant.llm.words import LETTER, LOWER, annotate, lists, words_of

TRAIN_ROWS = 20_000
FEATURES = 4096
LEAST_ROWS = 3  # training rows a feature occurs in
CUTS = (4, 5, 6)  # first bytes of words that are terms too
FACTORS = 4
PREDICT_AT = 0.7
_SEEDS = 7


@dataclass
class Machine:
    """Terms in order with their weights and factors; and the map from margin to probability."""

    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, texts: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """Linear part plus pairwise part of each text; ``texts`` and ``places`` pair texts with features."""
        linear = np.bincount(texts, weights=self.weights[places], minlength=n)
        pairs = np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[places, f]
            pairs += np.bincount(texts, weights=v, minlength=n) ** 2 - np.bincount(texts, weights=v * v, minlength=n)
        return self.intercept + linear + pairs / 2

    def scores(self, margins: np.ndarray) -> np.ndarray:
        """Probabilities. Pairs let margins grow with the square of the hits, so they are damped first."""
        damped = np.sign(margins) * np.log1p(np.abs(margins))
        return 1 / (1 + np.exp(-np.clip(self.slope * damped + self.shift, -40, 40)))


def terms_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms and the text each is in, with repeats."""
    words = words_of(column, LETTER, LOWER)
    whole, *heads = words.hashes(_SEEDS, CUTS)
    text, size = words.text, words.ends - words.starts
    longer = [size > cut for cut in CUTS]
    return (
        np.concatenate([whole, *(h[l] + np.uint64(cut) for h, l, cut in zip(heads, longer, CUTS))]),
        np.concatenate([text, *(text[l] for l in longer)]),
    )


def present(column, terms: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs. ``table`` says by the upper 20 bits which hashes may be features."""
    hashes, text = terms_of(column)
    maybe = table[hashes >> np.uint64(44)]
    hashes, text = hashes[maybe], text[maybe]
    at = np.minimum(np.searchsorted(terms, hashes), max(len(terms) - 1, 0))
    hit = terms[at] == hashes if len(terms) else np.zeros(0, bool)
    pairs = np.unique(text[hit] * np.int64(max(len(terms), 1)) + at[hit])
    return pairs // max(len(terms), 1), pairs % max(len(terms), 1)


def upper_bits(terms: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 20, bool)
    table[terms >> np.uint64(44)] = True
    return table


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Label and distinct terms of the bounded training sample."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def start():
        def step(piece: pa.RecordBatch) -> list:
            hashes, text = terms_of(piece.column("text"))
            order = np.lexsort((hashes, text))
            hashes, text = hashes[order], text[order]
            new = np.ones(len(text), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
            return [lists(hashes[new].view(np.int64), np.bincount(text[new], minlength=piece.num_rows), pa.int64())]
        return step

    return settle(annotate(rows, ["label"], "terms array<long>", start), "toxic-rows")


def choose_terms(rows: DataFrame, features: int = FEATURES, least_rows: int = LEAST_ROWS) -> tuple[list[int], float, int]:
    """Terms whose presence tells most about the label (log-likelihood ratio), the toxic share, rows."""
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < toxic < n:
        return [], (toxic / n if n else 0.0), n
    counts = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("all"), F.sum("label").alias("hit"))
    def part(a: Column, whole: Column, expected: float) -> Column:
        return F.when(a > 0, a * F.log(a / (whole * expected))).otherwise(0.0)
    p = toxic / n
    gain = part(F.col("hit"), F.col("all"), p) + part(F.col("all") - F.col("hit"), F.col("all"), 1 - p)
    top = counts.filter(F.col("all") >= least_rows).orderBy(gain.desc(), "term").limit(features)
    return [r["term"] for r in top.select("term").collect()], p, n


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, features: int = FEATURES, factors: int = FACTORS, iterations: int = 60) -> Machine:
    rows = training_rows(docs, labels, train_rows)
    chosen, share, n = choose_terms(rows, features)
    terms = np.sort(np.array(chosen, np.int64).view(np.uint64))
    if not len(terms):
        share = min(max(share, 0.0), 1.0)
        log_odds = -40.0 if share == 0 else 40.0 if share == 1 else float(np.log(share / (1 - share)))
        return Machine(terms, np.zeros(0), np.zeros((0, factors)), 0.0, slope=0.0, shift=log_odds)

    @F.udf(VectorUDT())
    def vector(row: list[int]):
        hashes = np.array(row, np.int64).view(np.uint64)
        return Vectors.sparse(len(terms), np.flatnonzero(np.isin(terms, hashes)), np.ones(int(np.isin(terms, hashes).sum())))

    frame = settle(rows.select("label", vector("terms").alias("features")), "toxic-vectors").cache()
    found = FMClassifier(factorSize=factors, maxIter=iterations, stepSize=0.1, regParam=1e-4, initStd=0.05, seed=7, solver="adamW").fit(frame)
    machine = Machine(terms, found.linear.toArray(), found.factors.toArray(), found.intercept)
    margin = F.element_at(vector_to_array("rawPrediction"), 2)
    margins = found.transform(frame).select("label", margin.alias("m"))
    damped = F.signum("m") * F.log1p(F.abs("m"))
    shape = LogisticRegression(regParam=1e-6, maxIter=100).fit(margins.select("label", array_to_vector(F.array(damped)).alias("features")))
    machine.slope, machine.shift = float(shape.coefficients[0]), float(shape.intercept)
    frame.unpersist()
    return machine


def score(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """The kept columns and ``_op5``, the probability of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def start():
        machine = shared.value
        table = upper_bits(machine.terms)

        def step(piece: pa.RecordBatch) -> list:
            texts, places = present(piece.column("text"), machine.terms, table)
            return [np.round(machine.scores(machine.margins(texts, places, piece.num_rows)), 9)]

        return step

    return annotate(docs, keep, "_op5 double", start)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_op5").alias("score"), (F.col("_op5") >= PREDICT_AT).cast("int").alias("predicted"))
