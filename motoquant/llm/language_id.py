"""Language by a bidirectional gated recurrent network over bytes (operator 12).

A text is read in windows of ``WINDOW`` bytes, all of them. In each, one recurrent pass runs forwards and
one backwards from zero state; both states give every byte a distribution over the learned languages,
and a document's probabilities are the mean over its bytes. The network is trained in numpy by
backpropagation through time: the windows of the training sample are dealt to shards, every shard takes
Adam steps through its windows in a Spark task, and the driver averages the shards after each round.

Training takes documents with a text and a language whose crc32 of the id modulo 5 is not 0 (a null id
counts as learnable): at most ``TRAIN_ROWS``, the same share of each language, by the smallest hash of
id and text, repeated rows once; of these at most ``TRAIN_WINDOWS`` windows by hash. The ``LANGUAGES``
most frequent languages are learned. Id, source and given language are no inputs of a prediction.

A null text or one without a letter is ``und`` with score 0, and so is every text if nothing could be
learned; a single learned language gets score 1. Ties go to the language first in code-point order.
Repeated rows score alike, empty tables give no rows, and the new column steps aside for carried
columns of its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motoquant.llm.store import free_name, settle, table
from motoquant.llm.words import annotate, text_buffer

WINDOW = 64  # bytes
STATE = 8  # units of each direction
TRAIN_ROWS = 4_000
TRAIN_WINDOWS = 32_768
LANGUAGES = 64
SHARDS = 8
ROUNDS = 6
BATCH = 128  # windows of one step
LEAST_STEPS = 32  # of a round; a small shard is gone through more than once
RATE = 0.02
SCORE_WINDOWS = 2_048  # windows scored at once
UNDETERMINED = "und"

_PAD = 256  # stands for no byte: its update gate is shut, so the state stays zero
_SHUT = -1e4


# --- the network -------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Network:
    """Input rows (byte by gates z, r, c), recurrent weights per direction, and the output layer.

    ``flat`` holds all parameters one after another; the others are views of it.
    """

    flat: np.ndarray
    classes: int
    units: int = STATE

    def __post_init__(self) -> None:
        shapes = [(2, _PAD + 1, 3 * self.units), (2, self.units, 3 * self.units), (2, self.units, self.classes), (self.classes,)]
        at, views = 0, []
        for shape in shapes:
            size = int(np.prod(shape))
            views.append(self.flat[at : at + size].reshape(shape))
            at += size
        self.inputs, self.recurrent, self.out, self.bias = views

    @staticmethod
    def size(classes: int, units: int = STATE) -> int:
        return 2 * (_PAD + 1) * 3 * units + 2 * units * 3 * units + 2 * units * classes + classes

    @staticmethod
    def start(classes: int, units: int = STATE, seed: int = 11, kind=np.float32) -> Network:
        net = Network((np.random.default_rng(seed).normal(0, 0.3, Network.size(classes, units))).astype(kind), classes, units)
        net.bias[:] = 0
        net.shut_pads()
        return net

    def shut_pads(self) -> None:
        self.inputs[:, _PAD] = 0
        self.inputs[:, _PAD, : self.units] = _SHUT

    def states(self, ids: np.ndarray, way: int) -> tuple[np.ndarray, ...]:
        """Of each step of one direction: states before and after, gates, candidate and its recurrent part."""
        steps, n, u = ids.shape[0], ids.shape[1], self.units
        kind = self.flat.dtype
        h = np.zeros((steps + 1, n, u), kind)
        z, r, c, g = (np.empty((steps, n, u), kind) for _ in range(4))
        for k in range(steps):
            t = k if way == 0 else steps - 1 - k
            a, b = self.inputs[way][ids[t]], h[k] @ self.recurrent[way]
            z[k], r[k] = _sigmoid(a[:, :u] + b[:, :u]), _sigmoid(a[:, u : 2 * u] + b[:, u : 2 * u])
            g[k] = b[:, 2 * u :]
            c[k] = np.tanh(a[:, 2 * u :] + r[k] * g[k])
            h[k + 1] = h[k] + z[k] * (c[k] - h[k])
        return h, z, r, c, g

    def loss(self, ids: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean cross-entropy over all bytes and its gradient, by backpropagation through time.

        ``ids`` is steps by windows, with ``_PAD`` after the last byte of a short window.
        """
        steps, n, u = ids.shape[0], ids.shape[1], self.units
        valid = (ids != _PAD).astype(self.flat.dtype)
        run = [self.states(ids, way) for way in (0, 1)]
        after = [run[0][0][1:], run[1][0][:0:-1]]  # states by byte
        logits = after[0] @ self.out[0] + after[1] @ self.out[1] + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        total = max(valid.sum(), 1)
        own = np.broadcast_to(label, (steps, n))
        picked = np.take_along_axis(p, own[:, :, None], 2)[:, :, 0]
        loss = float(-(np.log(np.maximum(picked, 1e-30)) * valid).sum() / total)
        d = p * (valid / total)[:, :, None]
        np.put_along_axis(d, own[:, :, None], np.take_along_axis(d, own[:, :, None], 2) - (valid / total)[:, :, None], 2)
        grad = Network(np.zeros_like(self.flat), self.classes, u)
        grad.bias[:] = d.sum(axis=(0, 1))
        order = np.argsort(ids, axis=None, kind="stable")
        seen, begin = np.unique(ids.ravel()[order], return_index=True)
        for way in (0, 1):
            h, z, r, c, g = run[way]
            grad.out[way] = np.tensordot(after[way], d, ((0, 1), (0, 1)))
            back = d @ self.out[way].T
            into = np.empty((steps, n, 3 * u), self.flat.dtype)
            dh = np.zeros((n, u), self.flat.dtype)
            for k in range(steps - 1, -1, -1):
                t = k if way == 0 else steps - 1 - k
                dh = dh + back[t]
                dc = dh * z[k] * (1 - c[k] * c[k])
                gates = np.concatenate((dh * (c[k] - h[k]) * z[k] * (1 - z[k]), dc * g[k] * r[k] * (1 - r[k]), dc * r[k]), axis=1)
                grad.recurrent[way] += h[k].T @ gates
                into[t, :, : 2 * u], into[t, :, 2 * u :] = gates[:, : 2 * u], dc
                dh = dh * (1 - z[k]) + gates @ self.recurrent[way].T
            grad.inputs[way][seen] = np.add.reduceat(into.reshape(-1, 3 * u)[order], begin, axis=0)
        grad.inputs[:, _PAD] = 0
        return loss, grad.flat

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        """Distribution of every byte, steps by classes by windows.

        Units lie along rows here, so every gate is one run of memory; a sigmoid is a tanh of halves.
        """
        steps, n, u = ids.shape[0], ids.shape[1], self.units
        kind = self.flat.dtype
        logits = np.empty((steps, self.classes, n), kind)
        halves = np.repeat(np.array([0.5, 1.0], kind), (2 * u, u))[:, None]
        gates, given, change, more = (np.empty((k, n), kind) for k in (3 * u, 3 * u, u, self.classes))
        for way in (0, 1):
            inputs, recurrent, out = (np.ascontiguousarray(m) for m in (self.inputs[way].T * halves, self.recurrent[way].T * halves, self.out[way].T))
            h = np.zeros((u, n), kind)
            for k in range(steps):
                t = k if way == 0 else steps - 1 - k
                np.take(inputs, ids[t], axis=1, out=given, mode="clip")
                np.matmul(recurrent, h, out=gates)
                shut = gates[: 2 * u]
                shut += given[: 2 * u]
                np.tanh(shut, out=shut)
                shut += 1
                shut *= 0.5
                np.multiply(gates[2 * u :], shut[u:], out=change)
                change += given[2 * u :]
                np.tanh(change, out=change)
                change -= h
                change *= shut[:u]
                h += change
                if way == 0:
                    np.matmul(out, h, out=logits[t])
                else:
                    logits[t] += np.matmul(out, h, out=more)
        logits += self.bias[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits


@dataclass
class Reader:
    """The learned languages in code-point order and their network; no network for less than two."""

    languages: list[str]
    network: Network | None

    def pooled(self, texts) -> np.ndarray:
        """Mean over all bytes of each text of the distribution over languages."""
        buffer, offsets = text_buffer(texts)
        size = np.diff(offsets)
        out = np.zeros((len(size), max(len(self.languages), 1)))
        if self.network is None:
            out[:, 0] = 1.0
            return out
        starts, ends, text = cut(offsets)
        # windows of like length together, so short texts are not padded to whole windows
        order = np.argsort(starts - ends, kind="stable")
        for k in range(0, len(order), SCORE_WINDOWS):
            at = order[k : k + SCORE_WINDOWS]
            ids = window_ids(buffer, starts[at], ends[at])
            p = self.network.probabilities(ids)
            p *= (ids != _PAD)[:, None, :]
            np.add.at(out, text[at], p.sum(axis=0, dtype=np.float64).T)
        return out / np.maximum(size, 1)[:, None]


def cut(offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of the windows of all texts, and the text each is in."""
    size = np.diff(offsets)
    count = -(-size // window)
    text = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    starts = offsets[text] + place * window
    return starts, np.minimum(starts + window, offsets[text + 1]), text


def window_ids(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes of the windows, steps by windows, padded to the longest."""
    at = np.arange(int((ends - starts).max()))[:, None] + starts[None, :]
    return np.where(at < ends[None, :], buffer[np.minimum(at, len(buffer) - 1)].astype(np.int64), _PAD)


# --- training ----------------------------------------------------------------------------------


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def training_windows(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_windows: int = TRAIN_WINDOWS, languages: int = LANGUAGES) -> tuple[list[str], DataFrame]:
    """The learned languages and the bounded sample: class and bytes of each window, dealt to shards.

    Rows are named by a hash, thinned by it to some four times what is wanted, and only then ranked.
    """
    key = F.xxhash64("doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"))
    rows = rows.filter(~held_out() & F.col("lang").isNotNull() & has_letter())
    names = rows.select("lang", key.alias("key")).distinct()
    counts = {r["lang"]: r["n"] for r in names.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    learned = sorted(counts)
    if len(learned) < 2:
        return learned, None
    each, parts = -(-train_rows // len(learned)), 1 << 30
    per_class = docs.sparkSession.createDataFrame([(l, k, min(parts, 4 * each * parts // counts[l] + 1)) for k, l in enumerate(learned)], "lang string, label int, below long")
    thinned = names.join(F.broadcast(per_class), "lang").filter(F.pmod(F.xxhash64("key", F.lit("row")), F.lit(parts)) < F.col("below"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("key", F.lit("row")), "key"))
    chosen = settle(thinned.select("lang", "label", "key", rank.alias("rank")).filter(F.col("rank") <= each).select("lang", "label", "key"), "language-rows")
    texts = rows.withColumn("key", key).join(F.broadcast(chosen), ["lang", "key"]).groupBy("label", "key").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buffer, offsets = text_buffer(batch.column("text"))
            starts, ends, text = cut(offsets)
            place = pa.array(text)
            data = pa.array([buffer[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist())], pa.binary())
            number = pa.array(starts - offsets[text], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("label").take(place), batch.column("key").take(place), number, data], ["label", "key", "at", "bytes"])

    windows = texts.mapInArrow(run, "label int, key long, at long, bytes binary")
    order = F.xxhash64("key", "at")
    best = Window.partitionBy("label").orderBy(order, "key", "at")
    sample = windows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= -(-train_windows // len(learned)))
    one = F.struct(order.alias("order"), "label", "bytes")
    shards = sample.groupBy((F.col("rank") % SHARDS).alias("shard")).agg(F.sort_array(F.collect_list(one)).alias("windows"))
    return learned, settle(shards.repartitionByRange(SHARDS, "shard"), "language-windows")


def steps(state: np.ndarray, classes: int, ids: np.ndarray, label: np.ndarray, begun: int, rate: float = RATE, batch: int = BATCH) -> np.ndarray:
    """Adam steps through the windows of one shard. ``state`` is parameters and both moments."""
    flat, first, second = (a.copy() for a in np.split(state, 3))
    net = Network(flat, classes)
    starts = range(0, len(label), batch)
    for k in range(max(len(starts), LEAST_STEPS)):
        at = starts[k % len(starts)]
        _, grad = net.loss(ids[:, at : at + batch], label[at : at + batch])
        grad /= max(1.0, float(np.sqrt((grad * grad).sum())))
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        t = begun + k + 1
        flat -= (rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)).astype(flat.dtype)
        net.shut_pads()
    return np.concatenate((flat, first, second))


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_windows: int = TRAIN_WINDOWS, rounds: int = ROUNDS) -> Reader:
    learned, shards = training_windows(docs, train_rows, train_windows)
    if shards is None:
        return Reader(learned, None)
    classes = len(learned)
    net = Network.start(classes)
    state, begun = np.concatenate((net.flat, np.zeros(2 * len(net.flat), np.float32))), 0
    for number in range(rounds):
        rate = RATE * (1 - number / rounds)

        def run(batches: Iterator[pa.RecordBatch], state=state, begun=begun, rate=rate) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, windows in zip(batch.column("shard").to_pylist(), batch.column("windows")):
                    rows = windows.values
                    data = rows.field("bytes").to_pylist()
                    buffer, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
                    ids, label = window_ids(buffer, offsets[:-1], offsets[1:]), rows.field("label").to_numpy()
                    made = steps(state, classes, ids, label, begun, rate)
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(label)], pa.int64()), pa.array([made.tobytes()], pa.binary())], ["shard", "windows", "state"])

        made = shards.mapInArrow(run, "shard int, windows long, state binary").orderBy("shard").collect()
        state = np.mean([np.frombuffer(r["state"], np.float32) for r in made], axis=0, dtype=np.float64).astype(np.float32)
        begun += max(LEAST_STEPS, -(-max(r["windows"] for r in made) // BATCH))
    return Reader(learned, Network(state[: len(net.flat)].copy(), classes))


# --- prediction --------------------------------------------------------------------------------


def identify(docs: DataFrame, reader: Reader, keep: list[str]) -> tuple[DataFrame, str]:
    """The kept columns and a struct of language and score, with the name of that column."""
    shared = docs.sparkSession.sparkContext.broadcast(reader)
    name = free_name([*keep, "text"], "language")
    inner = free_name([*keep, "text", name], "_raw")

    def start():
        reader = shared.value

        def step(piece: pa.RecordBatch) -> list:
            pooled = reader.pooled(piece.column("text"))
            return [pa.StructArray.from_arrays([pa.array(pooled.argmax(axis=1), pa.int32()), pa.array(np.clip(pooled.max(axis=1), 0, 1))], ["place", "score"])]

        return step

    known = F.array(*[F.lit(l) for l in reader.languages]).cast("array<string>")
    read = annotate(docs, list(dict.fromkeys([*keep, "text"])), f"`{inner}` struct<place: int, score: double>", start)
    sure = has_letter() & F.lit(bool(reader.languages))
    made = F.struct(
        F.when(sure, F.get(known, F.col(f"{inner}.place"))).otherwise(UNDETERMINED).alias("lang"),
        F.when(sure, F.round(F.col(f"{inner}.score"), 9)).otherwise(0.0).alias("score"),
    )
    return read.select(*[F.col(f"`{c}`") for c in keep], made.alias(name)), name


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found, name = identify(docs, train(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), F.col(f"{name}.lang").alias("lang_pred"), F.col(f"{name}.score").alias("score"))
