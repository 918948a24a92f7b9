"""Spelling variants against brute force: the words, their near words, forms and roots."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from motoquant.llm import spelling


def words_brute(rows):
    out = []
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out.append(run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run)
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def groups_brute(counts):
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), None if form[w] is None else counts[form[w]]))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    stems = ["".join(rng.choice(("ka", "lo", "mé", "tri", "ßen", "ö", "un", "AB")) for _ in range(rng.randrange(3, 6))) for _ in range(30)]
    def slip(w):
        k = rng.randrange(len(w))
        return rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice("aeÿ×") + w[k:], w[:k] + rng.choice("xyé") + w[k + 1 :]))
    pool = [w for k, w in enumerate(stems) for _ in range(1 + 40 * (k % 3))]
    texts = []
    for k in range(150):
        words = [slip(w) if rng.random() < 0.2 else w for w in rng.choices(pool, k=rng.randrange(1, 40))]
        texts.append("".join(w + rng.choice((" ", "-", "1", "\n", "Ā", "ſ")) for w in words))
    out = [(k * 7, t) for k, t in enumerate(texts)]
    return out + [(1, None), (None, texts[0]), (None, None), (2, ""), (3, "é" * 3000 + " " + "é" * 2999 + " " + "é" * 3000 + "x"), out[5], out[5], (out[6][0], texts[7])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string")


def test_words_and_counts(spark, rows):
    got = {r["word"]: r["n"] for r in spelling.count_words(frame(spark, rows).repartition(4)).collect()}
    assert got == {w: n for w, n in Counter(words_brute(rows)).items() if len(w) >= 7 and n >= 2} and any("é" in w for w in got)
    assert spelling.count_words(frame(spark, rows[:0])).count() == 0


@pytest.mark.parametrize("block_words", [1024, 4])
def test_groups_equal_brute_force(spark, rows, block_words):
    counts = spelling.count_words(frame(spark, rows))
    got = spelling.group_variants(counts.repartition(3), block_words=block_words).collect()
    want = groups_brute(Counter(words_brute(rows)))
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == want
    assert sum(r[1] is not None for r in want) > 20


def test_chains_of_forms_and_ties(spark):
    counts = {"aaaaaaa": 2000, "aaaaaab": 200, "aaaaabb": 20, "aaaaabbb": 2, "zzzzzzz": 50, "zzzzzzy": 50, "zzzzzz": 900, "zzzzzzx": 5, "ÿzzzzzzx": 2, "bbbbbbb": 2}
    got = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    # words come in with at least seven letters; one of six is in no block
    want = {r[0]: r for r in groups_brute(counts)}
    assert {r["word"]: tuple(r) for r in got if len(r["word"]) > 6} == want
    assert want["aaaaabbb"][1:3] == ("aaaaabb", "aaaaaaa") and want["aaaaabb"][1:3] == ("aaaaaab", "aaaaaaa") and want["zzzzzzx"][1] == "zzzzzzy"


def test_many_words_in_one_block_split_until_they_fit(spark):
    alphabet = "abcdefghij"
    words = ["".join(w) + "same" for w in itertools.product(alphabet, repeat=3)] + ["".join(w) + "samet" for w in itertools.product("ab", repeat=3)]
    counts = {w: 2 + 40 * (k % 50 == 0) for k, w in enumerate(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.group_variants(frame, block_words=30)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == groups_brute(counts)


def test_first_difference_finds_one_edit_only():
    rng = random.Random(2)
    made = ["".join(rng.choice("ab") for _ in range(rng.choice((4, 5)))) for _ in range(60)]
    pairs = [(a, b) for a in made for b in made if len(a) <= len(b) and a != b]
    pad = lambda w: np.frombuffer(w.ljust(6, "\0").encode(), np.uint8)
    got = spelling.first_difference(np.stack([pad(a) for a, _ in pairs]), np.stack([pad(b) for _, b in pairs]), np.array([len(b) > len(a) for a, b in pairs]))
    assert [p >= 0 for p in got] == [one_edit(a, b) for a, b in pairs]


def test_crc_of_words():
    data = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz" * 6, np.uint8)
    starts, ends = np.array([0, 3, 10, 20]), np.array([1, 9, 100, 21])
    begun = np.array([zlib.crc32(b"17:"), 0, zlib.crc32(b"x"), 5], np.uint32)
    assert spelling.crc_of_words(data, starts, ends, begun).tolist() == [zlib.crc32(data[s:e].tobytes(), int(b)) for s, e, b in zip(starts, ends, begun)]


def test_query_over_its_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in spelling.op11_spelling_variants(spark, sf_dir).collect()), key=lambda r: r[0])
    counts = {w: n for w, n in Counter(words_brute(rows)).items() if len(w) >= 7 and n >= 2}
    assert [(r[0], r[3]) for r in got] == sorted(counts.items())
    # near words of every word by looking up all its edits
    by = Counter()
    letters = sorted({c for w in counts for c in w})
    for w, n in counts.items():
        edits = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}
        by[w] = len((edits & counts.keys()) - {w})
    assert {r[0]: r[4] for r in got} == dict(by)
