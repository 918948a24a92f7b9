"""Language identification: the network against plain arithmetic, pooling, samples and held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from motoquant.llm import language_id
from motoquant.llm.language_id import Network, Reader

SYLLABLES = {"en": ("the", "ing", "wh", "tion", "ly"), "de": ("ein", "sch", "über", "keit", "zu"), "fr": ("eux", "oi", "ère", "que", "la")}


def text_of(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for k in range(400):
        lang = rng.choice(("en", "en", "en", "de", "fr"))
        out.append((k, text_of(rng, lang, rng.choice((2, 20, 60, 300))), lang))
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !? \n", "de"), (None, text_of(rng, "fr", 30), "fr"), (1003, text_of(rng, "de", 30000), "de"), (1004, text_of(rng, "en", 40), None), (1005, "é", None), (1006, "٣٤ ", "de")]
    return out + odd + [out[7]] * 50


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, "s", 1.5, 2) for i, t, l in rows], "doc_id long, text string, lang string, source string, language double, _raw int")


def plain(net: Network, data: bytes) -> list[list[float]]:
    """Distribution of every byte, one scalar at a time."""
    u, sig = net.units, lambda x: 1 / (1 + math.exp(-x))
    def run(way, order):
        h, out = [0.0] * u, {}
        for t in order:
            a = net.inputs[way][data[t]]
            b = [sum(h[i] * float(net.recurrent[way][i][j]) for i in range(u)) for j in range(3 * u)]
            z = [sig(float(a[j]) + b[j]) for j in range(u)]
            r = [sig(float(a[u + j]) + b[u + j]) for j in range(u)]
            c = [math.tanh(float(a[2 * u + j]) + r[j] * b[2 * u + j]) for j in range(u)]
            h = [(1 - z[j]) * h[j] + z[j] * c[j] for j in range(u)]
            out[t] = h
        return out
    f, g = run(0, range(len(data))), run(1, range(len(data) - 1, -1, -1))
    out = []
    for t in range(len(data)):
        raw = [math.exp(sum(f[t][i] * float(net.out[0][i][k]) + g[t][i] * float(net.out[1][i][k]) for i in range(u)) + float(net.bias[k])) for k in range(net.classes)]
        out.append([x / sum(raw) for x in raw])
    return out


def test_network_and_pooling_equal_plain_arithmetic():
    net = Network.start(3, units=4, seed=5, kind=np.float64)
    texts = ["abc", "", "größer als " * 9, "x" * 64, "y" * 65, "q" * 200 + "\U0001f600"]
    pooled = Reader(["a", "b", "c"], net).pooled(pa.array(texts + [None]))
    for text, got in zip(texts, pooled):
        data = text.encode()
        labels = [p for k in range(0, len(data), language_id.WINDOW) for p in plain(net, data[k : k + language_id.WINDOW])]
        assert len(labels) == len(data)
        assert np.allclose(got, np.mean(labels, axis=0) if labels else 0)
    assert not pooled[-1].any()


def test_gradient_equals_differences():
    net = Network.start(3, units=4, kind=np.float64)
    rng = np.random.default_rng(0)
    ids = rng.integers(97, 103, (7, 5))
    ids[4:, 1] = 256
    ids[2:, 3] = 256
    label = np.array([0, 1, 2, 1, 0])
    _, grad = net.loss(ids, label)
    for k in np.concatenate((rng.choice(np.flatnonzero(grad), 25), rng.choice(np.flatnonzero(grad == 0), 3))):
        sides = []
        for step in (1e-5, -1e-5):
            net.flat[k] += step
            sides.append(net.loss(ids, label)[0])
            net.flat[k] -= step
        assert math.isclose((sides[0] - sides[1]) / 2e-5, grad[k], rel_tol=1e-4, abs_tol=1e-8)


def test_sample_is_bounded_balanced_and_of_learnable_rows(spark, rows):
    learned, shards = language_id.training_windows(frame(spark, rows), train_rows=30, train_windows=90)
    assert learned == ["de", "en", "fr"]
    windows = [(w["label"], bytes(w["bytes"])) for s in shards.collect() for w in s["windows"]]
    assert len(windows) <= 90 and {l for l, _ in windows} == {0, 1, 2}
    def learnable(i, t, l):
        return l is not None and (i is None or zlib.crc32(str(i).encode()) % 5) and any(c.isalpha() for c in t or "")
    given = [(l, (t or "").encode()) for i, t, l in rows if learnable(i, t, l)]
    for label, data in windows:
        assert any(l == learned[label] and data in t for l, t in given)
    again = [(w["label"], bytes(w["bytes"])) for s in language_id.training_windows(frame(spark, rows).repartition(7), 30, 90)[1].orderBy("shard").collect() for w in s["windows"]]
    assert sorted(again) == sorted(windows)
    count = Counter(l for l, _ in set(given))
    assert language_id.training_windows(frame(spark, rows), languages=2)[0] == sorted(sorted(count, key=lambda l: (-count[l], l))[:2])


def test_held_out_accuracy_and_odd_texts(spark, rows):
    docs = frame(spark, rows).repartition(4)
    reader = language_id.train(docs, rounds=4)
    out, name = language_id.identify(docs, reader, ["doc_id", "lang", "language", "_raw"])
    assert name == "_language" and out.columns == ["doc_id", "lang", "language", "_raw", "_language"]
    got = out.collect()
    assert len(got) == len(rows)
    truth = [(r["lang"], r[name]["lang"]) for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(truth) > 50 and sum(a == b for a, b in truth) >= 0.98 * len(truth)
    by = {r["doc_id"]: tuple(r[name]) for r in got}
    assert all(by[i] == ("und", 0.0) for i in (1000, 1001, 1002, 1006)) and by[1005][0] in SYLLABLES and by[1003][0] == "de" and by[1004][0] == "en" and by[None][0] == "fr"
    assert all(0 <= s <= 1 for _, s in by.values())
    pooled = reader.pooled(pa.array([rows[7][1]]))[0]
    assert by[rows[7][0]] == (reader.languages[pooled.argmax()], round(pooled.max(), 9))


@pytest.mark.parametrize("given", [[], [(5, "abc", None)], [(5, "abc", "en"), (6, "def", "en"), (7, None, "de"), (8, "12", "fr")]])
def test_less_than_two_languages(spark, given):
    docs = frame(spark, given)
    reader = language_id.train(docs)
    out, name = language_id.identify(docs, reader, ["doc_id"])
    learnt = {l for i, t, l in given if l and t and t.isalpha() and zlib.crc32(str(i).encode()) % 5}
    want = {i: ("und", 0.0) if not learnt or not (t and t.isalpha()) else (*learnt, 1.0) for i, t, l in given}
    assert {r["doc_id"]: tuple(r[name]) for r in out.collect()} == want


def test_query_over_its_whole_table(spark, sf_dir):
    got = language_id.op12_language_id(spark, sf_dir).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert held and np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.9
