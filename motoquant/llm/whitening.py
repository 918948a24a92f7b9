"""Embedding whitening by a bit-sliced scatter matrix (operator 13).

Entries become whole numbers, so the scatter is exact: a task shifts each dimension by its least value,
packs every bit plane of it across rows into 64-bit words, and counts the ones of the AND of each pair
of planes; a count weighs 2**(p + q). Sums over tasks are whole numbers too, and the driver centres the
cross-products of the dimensions (d * d of them, no rows) as integers before ``eigh``.

Rows without a vector, with a null, non-finite or missing entry (a vector shorter than the longest
usable one) or with an entry whose whole number is outside ``LARGEST`` are dropped. The fit counts each
distinct whole-number vector once; copies are merged before the shuffle. Components whose variance is
below what doubles can tell from nothing are left out, so one distinct vector or an empty table gives no
rows. A deviation beyond a 64-bit integer is null. Repeated rows are whitened alike; a null id is kept.
Carried columns may have any names: the new column steps aside (``free_name``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from motoquant.llm.store import free_name, settle, table

SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 60  # whole numbers beyond it have no place in 64-bit arithmetic
COMPONENTS = 16
SLICE_ROWS = 1 << 15  # rows whose planes are packed at once
PART = 60  # bits of the lower part of a weighted count

_WIDTHS = (1, 2, 4, 8)


# --- whole-number vectors as bytes -------------------------------------------------------------


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * value), without the shift; exact, as scaling by a power of two is."""
    return np.floor(values * float(SCALE))


def pack_rows(x: np.ndarray) -> list[bytes]:
    """Each row as its byte width and its entries in that many bytes: equal rows give equal bytes."""
    width = np.ones(len(x), np.int64)
    for w in _WIDTHS[:-1]:
        edge = 1 << (8 * w - 1)
        width[(x < -edge).any(axis=1) | (x >= edge).any(axis=1)] = w * 2
    out: list[bytes] = [b""] * len(x)
    for w in _WIDTHS:
        at = np.flatnonzero(width == w)
        data = x[at].astype(f"<i{w}").tobytes()
        size = x.shape[1] * w
        for k, i in enumerate(at):
            out[i] = bytes((w,)) + data[k * size : (k + 1) * size]
    return out


def unpack_rows(column: pa.Array, dims: int) -> np.ndarray:
    """Rows packed by ``pack_rows`` as 64-bit integers."""
    out = np.empty((len(column), dims), np.int64)
    rows = column.to_pylist()
    width = np.array([r[0] for r in rows], np.int64)
    for w in _WIDTHS:
        at = np.flatnonzero(width == w)
        if len(at):
            out[at] = np.frombuffer(b"".join(rows[i][1:] for i in at), f"<i{w}").reshape(len(at), dims)
    return out


def encode(vectors: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """The carried columns as one struct, with the packed vector and its length, of usable rows."""
    carried = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("carried")
    rows = vectors.select(carried, F.col(f"`{column}`").cast("array<double>").alias("vector"))
    schema = T.StructType([rows.schema["carried"], *T._parse_datatype_string("dims int, packed binary").fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, at, packed, dims = batch.column("vector"), [], [], []
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            for d in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == d)
                flat = lists.take(pa.array(rows)).flatten().cast(pa.float64())
                x = whole(np.asarray(flat.fill_null(np.nan)).reshape(len(rows), d))
                usable = (np.abs(x) < LARGEST).all(axis=1)  # false for NaN and infinities too
                at += rows[usable].tolist()
                packed += pack_rows(x[usable].astype(np.int64))
                dims += [d] * int(usable.sum())
            if at:
                yield pa.RecordBatch.from_arrays([batch.column("carried").take(pa.array(at)), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], names)

    return rows.mapInArrow(run, schema)


# --- the fit -----------------------------------------------------------------------------------


def bit_planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of the columns of non-negative ``x`` as 64-bit words along rows; the column and bit of each."""
    bits = [int(c.max()).bit_length() if len(c) else 0 for c in x.T]
    words = -(-len(x) // 64)
    planes = np.zeros((sum(bits), words * 8), np.uint8)
    column = np.repeat(np.arange(len(bits)), bits)
    bit = np.concatenate([np.arange(b) for b in bits]) if bits else np.zeros(0, np.int64)
    for k, (c, b) in enumerate(zip(column.tolist(), bit.tolist())):
        row = np.packbits((x[:, c] >> b).astype(np.uint8) & 1)
        planes[k, : len(row)] = row
    return planes.view(np.uint64), column, bit.astype(np.int64)


def sliced_products(x: np.ndarray) -> list[list[int]]:
    """Exact cross-products of the columns of non-negative ``x``, from popcounts of plane pairs."""
    planes, column, bit = bit_planes(x)
    out = [[0] * x.shape[1] for _ in range(x.shape[1])]
    for k in range(len(planes)):
        ones = np.bitwise_count(planes[k] & planes[k:]).sum(axis=1, dtype=np.int64)
        i = int(column[k])
        for j, b, n in zip(column[k:].tolist(), bit[k:].tolist(), ones.tolist()):
            weight = int(bit[k]) + b
            # planes of one dimension meet in both orders, all but a plane with itself
            out[i][j] += n << (weight + (1 if i == j and b != bit[k] else 0))
    return out


@dataclass
class Whitener:
    """Sums and components of the distinct whole-number vectors, without their common shift."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]
    values: np.ndarray
    vectors: np.ndarray  # one column per component
    trace: float

    @property
    def means(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows: centred, turned to the components, each with variance one."""
        return (x - self.means) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum) squared, exact; null beyond 64 bits."""
        most = [max(abs(self.n * h - s), abs(self.n * l - s)) for h, l, s in zip(self.high, self.low, self.sums)]
        if sum(m * m for m in most) < 1 << 63 and max(abs(v) for v in (*self.low, *self.high)) * self.n < 1 << 62:
            off = x * np.int64(self.n) - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def _ranges(fit: DataFrame, dims: int) -> tuple[int, list[int], list[int], list[int]]:
    """Number of vectors, and least, largest and sum of every dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, total = 0, None, None, None
        for batch in batches:
            x = unpack_rows(batch.column("packed"), dims)
            if not len(x):
                continue
            n += len(x)
            fits = max(-int(x.min()), int(x.max())) * len(x) < 1 << 62
            sums = x.sum(axis=0).tolist() if fits else [sum(c) for c in x.T.tolist()]
            low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
            high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
            total = sums if total is None else [a + b for a, b in zip(total, sums)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims), pa.array(low), pa.array(high), pa.array([str(v) for v in total])], ["i", "n", "low", "high", "total"])

    parts = fit.select("packed").mapInArrow(run, "i int, n long, low long, high long, total string")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("i").collect()
    return (rows[0]["n"] if rows else 0), [r["low"] for r in rows], [r["high"] for r in rows], [int(r["total"]) for r in rows]


def scatter(fit: DataFrame, low: list[int]) -> list[list[int]]:
    """Exact cross-products of all distinct vectors after the shift by ``low``: one small matrix per task."""
    dims, least = len(low), np.array(low, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, rows = None, [], 0

        def slice_now() -> None:
            nonlocal total, held, rows
            if rows:
                part = sliced_products(np.concatenate(held))
                total = part if total is None else [[a + b for a, b in zip(p, q)] for p, q in zip(total, part)]
                held, rows = [], 0

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                x = unpack_rows(batch.column("packed").slice(at, SLICE_ROWS), dims) - least
                held.append(x)
                rows += len(x)
                if rows >= SLICE_ROWS:
                    slice_now()
        slice_now()
        if total is not None:
            flat = [(i, j, total[i][j] >> PART, total[i][j] & ((1 << PART) - 1)) for i in range(dims) for j in range(i, dims)]
            i, j, upper, lower = zip(*flat)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in upper]), pa.array(lower, pa.int64())], ["i", "j", "upper", "lower"])

    parts = fit.select("packed").mapInArrow(run, "i int, j int, upper string, lower long")
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("upper", "lower")]
    out = [[0] * dims for _ in range(dims)]
    for r in parts.groupBy("i", "j").agg(*whole).collect():
        out[r["i"]][r["j"]] = out[r["j"]][r["i"]] = (int(r["upper"]) << PART) + int(r["lower"])
    return out


def fit_components(fit: DataFrame, dims: int, components: int = COMPONENTS) -> Whitener | None:
    """Leading components of distinct packed vectors of ``dims`` entries; None without variance."""
    n, low, high, sums = _ranges(fit, dims)
    if n < 2:
        return None
    products = scatter(fit, low)
    shifted = [s - n * l for s, l in zip(sums, low)]
    centred = [[n * products[i][j] - shifted[i] * shifted[j] for j in range(dims)] for i in range(dims)]
    # a quotient of integers is rounded once
    covariance = np.array([[v / (n * n) for v in row] for row in centred])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    told = values > max(values[0], 0.0) * dims * np.finfo(float).eps * 16
    count = min(components, int(told.sum()))
    if not count:
        return None
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(dims)])  # the largest entry is positive
    trace = sum(centred[i][i] for i in range(dims)) / (n * n)
    return Whitener(n, sums, low, high, values[:count].copy(), (vectors * sign)[:, :count].copy(), trace)


def identity_error(fit: DataFrame, model: Whitener) -> float:
    """Largest entry of the whitened fit's covariance minus the identity."""
    shared = fit.sparkSession.sparkContext.broadcast(model)
    count = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total = np.zeros((count + 1, count))
        for batch in batches:
            w = model.project(unpack_rows(batch.column("packed"), len(model.sums)))
            total[:count] += w.T @ w
            total[count] += w.sum(axis=0)
        i, j = np.divmod(np.arange(total.size), count)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    parts = fit.select("packed").mapInArrow(run, "i int, j int, v double")
    total = np.zeros((count + 1, count))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = r["v"]
    mean = total[count] / model.n
    return float(np.abs(total[:count] / model.n - np.outer(mean, mean) - np.eye(count)).max())


def whiten(vectors: DataFrame, column: str = "embedding", keep: list[str] | None = None, components: int = COMPONENTS) -> tuple[DataFrame, Whitener | None, float | None]:
    """Usable rows with a struct of their deviation and whitened vector; the fit; its identity error.

    The struct is named ``whitened``, or with underscores in front where a carried column has that name.
    """
    spark = vectors.sparkSession
    keep = vectors.columns if keep is None else keep
    rows = settle(encode(vectors, column, keep), "packed-vectors")
    dims = rows.agg(F.max("dims")).first()[0]
    name = free_name(keep, "whitened")
    schema = T.StructType([rows.schema["carried"], *T._parse_datatype_string("made struct<deviation: long, vector: array<double>>").fields])
    model = None
    if dims is not None:
        rows = rows.filter(F.col("dims") == dims)
        fit = settle(rows.select("packed").distinct(), "distinct-vectors")
        model = fit_components(fit, dims, components)
    if model is None:
        return spark.createDataFrame([], schema).select("carried.*", F.col("made").alias(name)), None, None
    error = identity_error(fit, model)
    shared = spark.sparkContext.broadcast(model)
    kind = to_arrow_type(schema["made"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = unpack_rows(batch.column("packed"), dims)
            w = model.project(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            made = pa.StructArray.from_arrays([pa.array(model.deviations(x), pa.int64()), lists.cast(kind.field("vector").type)], fields=list(kind))
            yield pa.RecordBatch.from_arrays([batch.column("carried"), made], ["carried", "made"])

    out = rows.select("carried", "packed").mapInArrow(run, schema)
    return out.select("carried.*", F.col("made").alias(name)), model, error


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, error = whiten(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])
    n, explained = (model.n, model.explained.tolist()) if model else (0, [])
    share = F.array(*[F.lit(v) for v in explained]).cast("array<double>")
    entries = rows.select("vec_id", "whitened.deviation", F.posexplode("whitened.vector").alias("at", "value"))
    return entries.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.col("value").alias("whitened"), F.get(share, "at").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
