"""Quality classifier by co-training (operator 9).

Two logistic regressions see different views of a document: its text (hashed words and punctuation
runs) and its metadata (language, source, length and layout). Starting from labelled documents, each
round either view labels the unlabelled documents it is sure of for the other view. Both are then calibrated
on labelled documents that no round trained on (a fifth of each class; the training documents if a
class has only one), and a third regression on the two calibrated margins
gives the score of every document.

The labelled sample has at most ``LABELLED_ROWS`` documents, those of the smallest hash of their id.
Every round judges all unlabelled documents, and fits on all that it is sure of; scoring covers all
documents. Null texts are empty, null
metadata is a value of its own. Conflicting labels of one id count as bad. Without labels of both kinds
every score is the share of good labels, 0.5 if there are none. Repeated rows score alike. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motoquant.llm.quality import verdicts
from motoquant.llm.store import IDS, settle, table
from motoquant.llm.words import NOT_NEWLINE, annotate, byte_class, lists, split_kinds, split_words, sums, text_buffer
from motoquant.operators.joins import lookup_join
from motoquant.sources.tables import shared_dir

LABELLED_ROWS = 12_000
PARTITIONS = 4  # of the labelled sample: few enough for the fits to add up gradients without a shuffle
TASK_ROWS = 25_000  # unlabelled documents in a task of a fit
ROUNDS = 3
SURE = 0.95
TEXT_SIZE = 1 << 12
META_HASHED = 64
META_SIZE = META_HASHED + 5
META = ["lang", "source", "n_chars"]
_CAPITALS = byte_class(lambda b: 0x41 <= b <= 0x5A)


def text_view(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and value: damped counts of hashed words and punctuation runs, of unit length."""
    raw, offsets = text_buffer(column)
    units = split_kinds(raw, offsets)
    place = (units.hashes(3) >> np.uint64(64 - TEXT_SIZE.bit_length() + 1)).astype(np.int64)
    pairs, counts = np.unique(units.text * np.int64(TEXT_SIZE) + place, return_counts=True)
    text, place, value = pairs // TEXT_SIZE, pairs % TEXT_SIZE, np.log1p(counts)
    norm = np.sqrt(np.bincount(text, weights=value * value, minlength=len(offsets) - 1))
    return text, place, value / norm[text]


def meta_view(piece: pa.RecordBatch) -> np.ndarray:
    """Dense metadata: hashed language and source, length, lines, line length and its spread."""
    raw, offsets = text_buffer(piece.column("text"))
    out = np.zeros((piece.num_rows, META_SIZE))
    for name in ("lang", "source"):
        slots = [zlib.crc32(f"{name}={v}".encode()) % META_HASHED for v in piece.column(name).cast(pa.string()).to_pylist()]
        out[np.arange(len(slots)), slots] = 1.0
    given = piece.column("n_chars").cast(pa.float64()).fill_null(-1.0).to_numpy()
    lines = split_words(raw, offsets, NOT_NEWLINE)
    size = (lines.ends - lines.starts).astype(float)
    count = lines.counts
    mean = sums(size, lines.first) / np.maximum(count, 1)
    square = sums(size * size, lines.first) / np.maximum(count, 1)
    dense = [np.log1p(np.maximum(given, 0)) / 10, given < 0, np.log1p(count) / 5, np.log1p(mean) / 8, np.log1p(np.sqrt(np.maximum(square - mean * mean, 0))) / 8]
    out[:, META_HASHED:] = np.column_stack(dense)
    return out


@dataclass
class Linear:
    weights: np.ndarray
    intercept: float


@dataclass
class CoTrained:
    """Margins of both views, their calibrations (slope and shift), and the regression on both."""

    text: Linear
    meta: Linear
    calibrations: tuple[tuple[float, float], tuple[float, float]]
    both: Linear

    def scores(self, text_margin: np.ndarray, meta_margin: np.ndarray) -> list[np.ndarray]:
        margins = [np.clip(a * m + b, -30, 30) for m, (a, b) in zip((text_margin, meta_margin), self.calibrations)]
        total = self.both.intercept + sum(w * m for w, m in zip(self.both.weights, margins))
        return [np.round(1 / (1 + np.exp(-np.clip(m, -30, 30))), 9) for m in (*margins, total)]


VIEWS = ", ".join(f"{view} struct<type: tinyint, size: int, indices: array<int>, values: array<double>>" for view in ("text", "meta"))


def samples(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """Both views of the labelled sample and of all unlabelled documents."""
    good = verdicts(labels).select("doc_id", F.col("good").cast("double").alias("label"))
    known = settle(good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows).select("doc_id", F.lit(True).alias("chosen")), "co-rows")
    marks = settle(good.join(F.broadcast(known), "doc_id", "left"), "co-labels")
    rows = lookup_join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *META), marks, "doc_id", rules=IDS).filter("label is null or chosen")

    def vectors(kind: int, size: int | None, indices: pa.Array, values: pa.Array) -> pa.Array:
        n = len(values)
        return pa.StructArray.from_arrays([pa.array([kind] * n, pa.int8()), pa.array([size] * n, pa.int32()), indices, values], ["type", "size", "indices", "values"])

    def start():
        def step(piece: pa.RecordBatch) -> list:
            text, place, value = text_view(piece.column("text"))
            per_row = np.bincount(text, minlength=piece.num_rows)
            meta = lists(meta_view(piece).ravel(), np.full(piece.num_rows, META_SIZE), pa.float64())
            return [
                vectors(0, TEXT_SIZE, lists(place, per_row, pa.int32()), lists(value, per_row, pa.float64())),
                vectors(1, None, pa.nulls(piece.num_rows, pa.list_(pa.int32())), meta),
            ]
        return step

    # written as the plain columns of a vector and read as vectors, so no row passes through Python objects
    path = shared_dir(docs.sparkSession, "co-vectors")
    annotate(rows, ["doc_id", "label"], VIEWS, start, read=META).write.parquet(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.DoubleType()), T.StructField("text", VectorUDT()), T.StructField("meta", VectorUDT())])
    return docs.sparkSession.read.schema(schema).parquet(path)


def deal_held(known: DataFrame) -> DataFrame:
    """The labelled sample with ``held``: a fifth of each class, and one of both kinds where a class has two."""
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit("calibrate")), "doc_id")
    dealt = known.select("doc_id", "label").distinct().select("doc_id", (F.row_number().over(order) % 5 == 2).alias("held"))
    return known.join(F.broadcast(dealt), "doc_id").select("doc_id", "label", "held", "text", "meta")


def _fit(rows: DataFrame, view: str, partitions: int = PARTITIONS):
    return LogisticRegression(featuresCol=view, labelCol="label", regParam=1e-3, maxIter=40).fit(rows.coalesce(partitions))


def _margin(rows: DataFrame, model, view: str) -> DataFrame:
    scored = model.transform(rows.select("doc_id", "label", "held", "text", "meta"))
    return scored.select("doc_id", "label", "held", "text", "meta", _second("rawPrediction").alias("margin"))


def _second(vector: str) -> Column:
    return F.element_at(vector_to_array(vector), 2)


def co_train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS, sure: float = SURE) -> CoTrained:
    frame = samples(docs, labels, labelled_rows)
    known = deal_held(frame.filter("label is not null").repartition(PARTITIONS)).cache()
    share = known.agg(F.avg("label")).first()[0]
    own = known.filter("not held")
    kinds = own.agg(F.count_distinct("label")).first()[0]
    check = known.filter("held").agg(F.count_distinct("label")).first()[0]
    if kinds < 2:
        share = 0.5 if share is None else min(max(share, 1e-9), 1 - 1e-9)
        none = Linear(np.zeros(2), float(np.log(share / (1 - share))))
        return CoTrained(Linear(np.zeros(TEXT_SIZE), 0.0), Linear(np.zeros(META_SIZE), 0.0), ((0.0, none.intercept), (0.0, none.intercept)), none)
    pool = frame.filter("label is null").select("doc_id", "label", F.lit(False).alias("held"), "text", "meta")
    partitions = max(PARTITIONS, -(-pool.count() // TASK_ROWS))
    edge = float(np.log(sure / (1 - sure)))
    models = {view: _fit(own, view) for view in ("text", "meta")}
    for _ in range(rounds):
        lent = {}
        for view, other in (("text", "meta"), ("meta", "text")):
            certain = _margin(pool, models[view], view).filter(F.abs("margin") >= edge)
            lent[other] = certain.withColumn("label", (F.col("margin") > 0).cast("double")).drop("margin")
        models = {view: _fit(own.unionByName(lent[view].select(*own.columns)), view, partitions) for view in models}
    held = known.filter("held") if check == 2 else own
    calibrations = []
    for view in ("text", "meta"):
        line = _fit(_margin(held, models[view], view).select("label", array_to_vector(F.array("margin")).alias("m")), "m")
        calibrations.append((float(line.coefficients[0]), float(line.intercept)))
    (ta, tb), (ma, mb) = calibrations
    by_text = _margin(held, models["text"], "text").select("label", "meta", "margin")
    by_both = models["meta"].transform(by_text)
    views = F.array(F.col("margin") * ta + tb, _second("rawPrediction") * ma + mb)
    stacked = _fit(by_both.select("label", array_to_vector(views).alias("m")), "m")
    known.unpersist()
    linear = lambda m: Linear(m.coefficients.toArray(), float(m.intercept))
    return CoTrained(linear(models["text"]), linear(models["meta"]), tuple(calibrations), linear(stacked))


def score(docs: DataFrame, model: CoTrained, keep: list[str]) -> DataFrame:
    """The kept columns and ``_op9``: calibrated score of each view and of both."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value

        def step(piece: pa.RecordBatch) -> list:
            text, place, value = text_view(piece.column("text"))
            a = model.text.intercept + np.bincount(text, weights=model.text.weights[place] * value, minlength=piece.num_rows)
            b = model.meta.intercept + meta_view(piece) @ model.meta.weights
            return [pa.StructArray.from_arrays([pa.array(s) for s in model.scores(a, b)], ["text_score", "meta_score", "score"])]

        return step

    return annotate(docs, keep, "_op9 struct<text_score: double, meta_score: double, score: double>", start, read=META)


def op9_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, co_train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", "_op9.text_score", "_op9.meta_score", "_op9.score", (F.col("_op9.score") >= 0.5).alias("kept"))
