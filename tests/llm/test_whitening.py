"""Embedding whitening against exact arithmetic on small tables with awkward rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from motoquant.llm import whitening

NAN, INF = float("nan"), float("inf")


def brute(rows, components=16):
    """Ids, deviations and whitened rows, distinct vectors, shares: whole numbers until the eigenvectors."""
    used = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(x) for _, x in used), default=0)
    used = [(i, x) for i, x in used if len(x) == dims]
    fit = sorted({tuple(x) for _, x in used})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    cov = np.array([[sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit) / (n * n) / n for j in range(dims)] for i in range(dims)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    count = min(components, int((e > e[0] * 1e-12).sum())) if n > 1 else 0
    mean = np.array([a / n for a in s])
    out = []
    for i, x in used:
        w = (np.array(x) - mean) @ v[:, :count] / np.sqrt(e[:count])
        out.append((i, sum((n * a - b) ** 2 for a, b in zip(x, s)), w))
    return out, n, e[:count] / e.sum()


def awkward(seed=3, dims=7, n=90):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1 + k) + (k == 2) * 40 for k in range(dims)] for _ in range(n)]
    rows = list(enumerate(base))
    rows += [(n + k, list(base[5])) for k in range(60)]  # copies in a large group
    rows += [(3, list(base[3])), (None, list(base[4])), (900, None), (901, [1.0] * (dims - 1) + [None]), (902, [NAN] * dims), (903, [INF] + [0.0] * (dims - 1)), (904, []), (905, [1.0] * (dims - 1))]
    rows += [(906, [1e4] + [0.25] * (dims - 1)), (907, [-0.001] * dims)]
    return rows


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 1, "a", 2.5) for i, v in rows], f"vec_id long, embedding array<{kind}>, n int, whitened string, `odd name` double")


def key(row):
    return (row[0] is None, row[0] or 0, row[1])


def test_whitened_rows_equal_exact_arithmetic(spark):
    rows = awkward()
    out, model, error = whitening.whiten(frame(spark, rows).repartition(6), keep=["vec_id", "whitened", "odd name"])
    assert out.columns == ["vec_id", "whitened", "odd name", "_whitened"]
    want, n, shares = brute(rows)
    got = sorted(((r[0], r[3]["deviation"], r[3]["vector"]) for r in out.collect()), key=key)
    want = sorted(want, key=key)
    assert model.n == n and error < 1e-9 and [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose(model.explained, shares, rtol=1e-9) and len(shares) == 7
    a, b = np.array([g[2] for g in got]), np.array([w[2] for w in want])
    assert np.allclose(a, b * np.sign((a * b).sum(axis=0)), atol=1e-8)


def test_sliced_products_are_the_plain_ones():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 200):
        x = rng.integers(0, (1, 2, 9, 1 << 40), (n, 4))
        assert whitening.sliced_products(x) == [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j])) if j >= i else 0 for j in range(4)] for i in range(4)]


def test_packed_rows_come_back_and_name_vectors():
    x = np.array([[0, 1], [127, -128], [128, 0], [-32769, 5], [1 << 40, -3], [0, 1]], np.int64)
    packed = whitening.pack_rows(x)
    import pyarrow as pa
    assert whitening.unpack_rows(pa.array(packed, pa.binary()), 2).tolist() == x.tolist()
    assert packed[0] == packed[5] and len(set(packed)) == 5


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]])
def test_tables_without_variance_give_no_rows(spark, rows):
    out, model, error = whitening.whiten(frame(spark, rows))
    assert out.count() == 0 and model is None and error is None and out.columns[-1] == "_whitened"


def test_constant_and_dependent_dimensions_leave_fewer_components(spark):
    rows = [(k, [float(k), 3.0, float(2 * k), float(k * k % 7)]) for k in range(40)]
    out, model, error = whitening.whiten(frame(spark, rows, "float"), keep=["vec_id"])
    assert len(model.values) == 2 and error < 1e-9 and out.count() == 40


def test_wide_entries_stay_exact(spark):
    rows = [(k, [k * 1e12, (k % 3) * 1.0]) for k in range(9)]
    out, model, _ = whitening.whiten(frame(spark, rows), keep=["vec_id"])
    want, n, _ = brute(rows)
    assert {r[0]: r[1]["deviation"] for r in out.collect()} == {i: d if d < 1 << 63 else None for i, d, _ in want}


def test_query_over_its_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, n, shares = brute(rows)
    got = whitening.op13_embedding_whitening(spark, sf_dir).collect()
    assert len(got) == 16 * len(want)
    assert {(r["vec_id"], r["n"], r["deviation"]) for r in got} == {(i, n, d) for i, d, _ in want}
    by = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    a = np.array([[by[i, c + 1] for c in range(16)] for i, _, _ in want])
    b = np.array([w for _, _, w in want])
    assert np.allclose(a, b * np.sign((a * b).sum(axis=0)), atol=1e-6)
    assert np.allclose(sorted({r["explained"] for r in got}, reverse=True), shares, rtol=1e-9) and {r["identity_error"] < 1e-9 for r in got} == {True}
