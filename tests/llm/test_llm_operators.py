"""The training-data operators against brute force on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motoquant.llm import cotraining, decontamination, jaccard_join, line_dedup, packing, quality, sharding, substring_dedup, toxicity, url_rules
from motoquant.llm.words import LETTER, LOWER, words_of

SPACE_WORDS = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", score double, n_words long, row string, key int, `set` string, shard int"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def table(spark, rows, extra=False):
    """doc_id, text and source; the rest is filled in, with clashing columns if asked."""
    full = [(i, t, None if n % 5 == 4 else "en", s, None if t is None else len(t)) + ((0.5, 7, "x", 1, "y", 9) if extra else ()) for n, (i, t, s) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS + (EXTRA if extra else ""))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [a + b for a in ("ka", "lo", "mi", "né", "Tu", "ß") for b in ("ra", "st", "un", "q", "!", "-x", "9")]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for n in range(120):
        words = [rng.choice(vocabulary) + rng.choice("abcdefgh") * rng.randrange(3) for _ in range(rng.choice((3, 12, 40, 90)))]
        if n % 6 == 0:
            words[len(words) // 2 : len(words) // 2] = passage[: rng.choice((20, 49, 50, 60))]
        out.append(words)
    for n in range(40):  # near copies, of copies too
        words = list(out[rng.randrange(len(out))])
        for _ in range(rng.choice((0, 1, 1, 3))):
            words[rng.randrange(len(words))] = "changed" + str(n)
        out.append(words)
    made = ["".join(w + rng.choice((" ", " ", "  ", "\n", "\t")) for w in words) for words in out]
    return made + ["", " \n\t ", "one", "ONE", "a b", "a b c d", "x" * 5000, "\u00a0nbsp \u2003em", "Ώ é 'll <|endoftext|> 12a"]


@pytest.fixture(scope="module")
def rows(texts):
    out = [(n * 3 % 1009, t, f"s{n % 7}") for n, t in enumerate(texts)]
    return out + [(2000, None, "s1"), (None, texts[0], "s2"), (None, None, None), out[3], out[3], (out[4][0], texts[9], None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows, extra=True).repartition(5)


@pytest.fixture(scope="module")
def no_docs(spark):
    return table(spark, [])


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_words_are_those_of_the_pattern(texts):
    for inside, pattern, low in ((None, SPACE_WORDS, False), (LETTER, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        words = words_of(pa.array(texts + [None]), *((inside, LOWER) if low else ()))
        want = [re.findall(pattern, fold(t) if low else t) for t in texts] + [[]]
        assert words.counts.tolist() == [len(w) for w in want]
        assert [words.word(i).decode() for i in range(len(words.starts))] == [w for t in want for w in t]
        by = defaultdict(set)
        for w, h in zip((w for t in want for w in t), words.hashes().tolist()):
            by[w].add(h)
        assert len({h for x in by.values() for h in x}) == len(by) and all(len(x) == 1 for x in by.values())


# --- 1 ----------------------------------------------------------------------------------------


def base_brute(text):
    words = re.findall(SPACE_WORDS, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(SPACE_WORDS, x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    twice = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice)]


def test_quality_counts_and_scores(spark, docs, no_docs, rows, texts):
    more = ["a b c d e f a b c d e f", "x\ny\nx\n \n \nx", "### | <a>" * 4, *texts]
    assert np.array_equal(np.column_stack(list(quality.base_counts(pa.array(more)).values())), [base_brute(t) for t in more])
    labels = labels_of(spark, [(i, int(n % 3 > 0), 0) for n, (i, _, _) in enumerate(rows) if i is not None] + [(None, 1, 1), (3, None, None)])
    counts = quality.count_grams(docs, labels)
    good = {r[0] for r in quality.verdicts(labels).filter("good").collect()}
    raw, trusted, own = Counter(), Counter(), []
    for i, t, _ in rows:
        bucket = quality.gram_buckets(pa.array([t], pa.string()))[0].tolist()
        raw.update(bucket)
        trusted.update(bucket if i in good else [])
        own.append(bucket)
    size = quality.BUCKETS
    ratio = {b: math.log((trusted[b] + 1) / (sum(trusted.values()) + size)) - math.log((raw[b] + 1) / (sum(raw.values()) + size)) for b in raw}
    want = sorted((str(i), round(sum(ratio[b] for b in x) / len(x), 6) if x else 0.0) for (i, _, _), x in zip(rows, own))
    measured = quality.measure(docs, counts, ["doc_id"]).select("doc_id", "_op1.score").collect()
    assert sorted((str(r[0]), round(r[1], 6) + 0.0) for r in measured) == want
    assert quality.measure(no_docs, quality.count_grams(no_docs, labels), ["doc_id"]).count() == 0
    assert quality.count_grams(docs, labels.limit(0)).ratios().any() == False  # noqa: E712
    assert quality.find_threshold(quality.measure(docs, counts, ["doc_id"]), labels.limit(0)) == quality.LOWEST


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quality_threshold_separates_best_of_all_thresholds(spark, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for n in range(300):
        good = rng.random() < 0.6
        words, repeats = rng.choice(((50, 0), (50, 0), (9, 0), (50, 11)))
        rows.append((n, (words, 200, 0, 0, repeats, round(rng.gauss(0.2 if good else -0.1, 0.15), 4))))
        labels += [(n, int(good), 0)] if n % 3 else []
    labels += [(3, None, 0), (None, 1, 0), (5000, 1, 0), (1, 0, 0)]  # conflicting labels of one id count as bad
    fields = quality.FIELDS.split(" ", 1)[1]
    measured = spark.createDataFrame(rows, f"doc_id long, _op1 {fields}")
    found = quality.find_threshold(measured, labels_of(spark, labels))
    good = {i: all(q == 1 for j, q, _ in labels if j == i and q is not None) for i in {j for j, q, _ in labels if j is not None and q is not None}}
    judged = [(m[-1], good[i]) for i, m in rows if i in good and m[0] >= 10 and 100 * m[4] <= 20 * m[0]]
    def gain(at):
        shares = [[s < at for s, g in judged if g == kind] for kind in (False, True)]
        return sum(shares[0]) / len(shares[0]) - sum(shares[1]) / len(shares[1])
    edges = sorted({math.floor(s * quality.BINS_PER_UNIT) / quality.BINS_PER_UNIT for s, _ in judged})
    best = max(gain(e) for e in [*edges, 9.0])
    assert abs(gain(found) - best) < 1e-9 and best > 0.4
    kept = {r[0] for r in measured.filter(quality.kept(found)).collect()}
    assert kept == {i for i, m in rows if m[0] >= 10 and 100 * m[4] <= 20 * m[0] and m[-1] >= found}


def test_quality_counts_every_trusted_document(spark):
    ids = spark.range(70_000).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id"))
    labels = ids.select("doc_id", F.when(F.col("doc_id") % 7 > 0, 1).otherwise(0).alias("quality"))
    counts = quality.count_grams(ids.select("doc_id", F.lit("word").alias("text")), labels.union(labels.filter("doc_id > 69999 - 10").withColumn("quality", F.lit(1))))
    assert counts.raw.sum() == 70_000 and counts.trusted.sum() == sum(n % 7 > 0 for n in range(70_000))
    many = ids.withColumn("doc_id", F.col("doc_id") + 100_000).filter("doc_id is not null").withColumn("quality", F.lit(1))
    counts = quality.count_grams(many.select("doc_id", F.lit("word").alias("text")), many)
    assert counts.raw.sum() == counts.trusted.sum() == 69_999


# --- 2 ----------------------------------------------------------------------------------------


def shingle_set(text, k):
    words = re.findall(SPACE_WORDS, fold(text))
    return frozenset([tuple(words)] if 0 < len(words) < k else [tuple(words[i : i + k]) for i in range(len(words) - k + 1)])


def components_brute(rows, k, num, den):
    rows = sorted(set(rows), key=str)
    sets, parent = [shingle_set(t, k) for _, t in rows], list(range(len(rows)))
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        least[root(n)] += [i] if i is not None else []
    return {r: (len(sets[n]), min(least[root(n)], default=None) if sets[n] else r[0]) for n, r in enumerate(rows)}


@pytest.mark.parametrize("k,num,block", [(4, 85, 2048), (5, 80, 2), (2, 60, 3)])
def test_jaccard_components(docs, rows, monkeypatch, k, num, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(jaccard_join, "BATCH_MEMBERS", 4)
    want = components_brute([(i, t) for i, t, _ in rows], k, num, 100)
    got = jaccard_join.near_duplicates(docs, jaccard_join.Similarity(k, num)).drop("row", "group").collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *want[i, t]) for i, t, _ in rows)


def test_jaccard_hub_group_and_empty(spark, no_docs):
    rng = random.Random(1)
    base = [f"w{n}" for n in range(80)]
    rows = []
    for n in range(60):  # copies edited more or less, linked through the base or not
        words = list(base)
        for at in rng.sample(range(80), rng.choice((0, 1, 1, 2, 4, 8))):
            words[at] = f"e{n}x{at}"
        rows.append((n, " ".join(words), "s"))
    want = components_brute([(i, t) for i, t, _ in rows], 4, 85, 100)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: want[i, t][1] for i, t, _ in rows}
    assert jaccard_join.near_duplicates(no_docs).count() == 0


def test_sketch_never_exceeds_difference(texts):
    found, first = jaccard_join.shingles(pa.array(texts), 4)
    sketch = [np.frombuffer(s, np.uint64) for s in jaccard_join.sketches(found, first)]
    sets = [set(found[a:b].tolist()) for a, b in zip(first, first[1:])]
    for a in range(0, len(sets), 3):
        for b in range(a):
            assert np.bitwise_count(sketch[a] ^ sketch[b]).sum() <= len(sets[a] ^ sets[b])


# --- 3 ----------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [
        "http://WWW.Example.com/en/1?x#y", "https://a.example.com/en/2", "http://example.com/de/", "http://b.net/es/3", "http://net/fr/", "http://b.net/en/3",
        "http://com", "http://com/", "HTTP://x.com:80/a", "nothing", "", None, "a://", "http://host?x/y", "http://h#f", "http://x.org/es/", "://net/es/", "http://a.com.net/fr/q://z",
    ]
    want = [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("a.example.com", "/en/2", "example.com/en/", "block"), ("example.com", "/de/", "com/", "allow"),
        ("b.net", "/es/3", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block"), ("b.net", "/en/3", None, "allow"), ("com", "", None, "allow"), ("com", "/", "com/", "allow"),
        ("x.com:80", "/a", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("host", "", None, "allow"),
        ("h", "", None, "allow"), ("x.org", "/es/", None, "allow"), ("net", "/es/", "net/es/", "block"), ("a.com.net", "/fr/q://z", "net/fr/", "block"),
    ]
    pages = spark.createDataFrame([(n, u, "h", "v") for n, u in enumerate(urls)] + [(None, urls[0], "h", "v")], "page_id long, url string, html string, verdict string")
    none = labels_of(spark, [])
    got = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge_pages(pages, none).collect()}
    assert got == {n: w for n, w in enumerate(want)} | {None: want[0]}
    assert url_rules.judge_pages(pages.limit(0), none).count() == 0


def test_url_rules_are_mined(spark):
    urls, labels = [], []
    for n in range(200):
        bad = n % 4 == 0
        urls.append((n, f"http://h{'abcdefghij'[n % 10]}.org/{'casino' if bad or n % 4 == 1 else 'news'}/{'win' if bad or n % 4 == 2 else 'day'}/{n}"))
        labels.append((n, 1, int(bad)))
    urls += [(900, "http://zz.org/casino/win"), (901, "http://zz.org/casino/day"), (902, "http://zz.org/news/win")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge_pages(pages, labels_of(spark, labels)).collect()}
    assert (got[900], got[901], got[902]) == ("block", "allow", "allow")
    assert all(got[n] == ("block" if n % 4 == 0 else "allow") for n in range(200))
    rules = url_rules.mine(url_rules.labelled_urls(pages, labels_of(spark, labels))).filter("verdict = 'block'").collect()
    assert ["p:casino", "p:win"] in [r["tokens"] for r in rules] and all(len(r["tokens"]) == 2 for r in rules)


def mined_brute(rows, least, confidence, lean):
    """Rules as (verdict, token set, confidence), by trying every combination of up to four tokens."""
    out, n = set(), len(rows)
    for label in ("allow", "block"):
        base = sum(l == label for _, l in rows) / n
        def share(tokens):
            pages = [l for own, l in rows if tokens <= own]
            return len(pages), (sum(l == label for l in pages) / len(pages) if pages else 0)
        leaning = []
        for t in sorted(set().union(*(own for own, _ in rows))):
            pages, part = share({t})
            if round(pages * part) >= least and part > base and part - base >= lean * math.sqrt(base * (1 - base) / pages):
                leaning.append(t)
        alone = {t for t in leaning if share({t})[1] >= confidence}
        found = [{t} for t in alone]
        rest = [t for t in leaning if t not in alone]
        pages_of = {t: frozenset(k for k, (own, _) in enumerate(rows) if t in own) for t in rest}
        for size in (2, 3, 4):
            for combo in itertools.combinations(rest, size):
                pages, part = share(set(combo))
                if part >= confidence and sum(l == label for own, l in rows if set(combo) <= own) >= least and len({pages_of[t] for t in combo}) == size and not any(f < set(combo) for f in found if len(f) < size):
                    found.append(set(combo))
        out |= {(label, frozenset(f), round(share(f)[1], 9)) for f in found}
    return out


def expanded(rules):
    return {(r["verdict"], frozenset(c), round(r["confidence"], 9)) for r in rules.collect() for c in itertools.product(*r["parts"])}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mined_rules_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for n in range(160):
        bad = rng.random() < 0.4
        host, path = rng.choice("aab" if bad else "abc"), rng.choice(["x", "x", "y"] if bad else ["x", "y", "z"])
        query = "&".join(q + "=1" for q in ("s", "t") if n % 2) + ("&u=2" if rng.random() < (0.7 if bad else 0.4) else "")
        rows.append((n, f"http://{host}.org/{path}/{path if n % 3 else 'w'}{n}?{query}", "block" if bad or (host, path) == ("a", "y") else "allow"))
    labelled = spark.createDataFrame(rows, "id int, url string, label string")
    tokens = {r["url"]: set(r["own"]) for r in labelled.select("url", url_rules.url_tokens(F.col("url")).alias("own")).collect()}
    mining = url_rules.Mining(confidence=0.75, least_pages=8, lean=1.0)
    want = mined_brute([(tokens[u], l) for _, u, l in rows], 8, 0.75, 1.0)
    got = expanded(url_rules.mine(labelled.select("url", "label").repartition(3), mining))
    assert got == want and any(len(f) > 1 for _, f, _ in want)


def test_templates_of_many_tokens_are_mined_in_bounded_time(spark):
    """Thirty query names shared by all urls, or by all of one kind: no combinations of them are tried."""
    names = "&".join(f"track{chr(97 + k // 26)}{chr(97 + k % 26)}=1" for k in range(30))
    rows = [(f"http://a.org/{'bad' if n % 4 == 0 else 'good'}{'pq'[n % 2]}/x{n}?{names}", "block" if n % 4 == 0 else "allow") for n in range(400)]
    rules = url_rules.mine(spark.createDataFrame(rows, "url string, label string"))
    assert {(r["verdict"], *r["tokens"]) for r in rules.collect()} == {("block", "p:badp"), ("allow", "p:goodp"), ("allow", "p:goodq")}
    rows = [(f"http://a.org/x{n}" + (f"?{names}" if n % 4 == 0 or n % 40 == 1 else ""), "block" if n % 4 == 0 else "allow") for n in range(400)]
    rules = url_rules.mine(spark.createDataFrame(rows, "url string, label string"))
    assert len(expanded(rules)) == 30 and all(len(r["tokens"]) == 1 for r in rules.collect())


def test_rules_of_tokens_that_go_with_no_label_alone(spark):
    """Each of a, b, x, y stands on as many blocked as allowed pages; only pairs tell them apart."""
    rows = [(f"http://{h}.org/{p}/{n}", "block" if (h, p) in (("a", "x"), ("b", "y")) else "allow") for n in range(25) for h in "ab" for p in "xy"]
    rules = url_rules.mine(spark.createDataFrame(rows, "url string, label string")).collect()
    pairs = {("block", "h:a", "p:x"), ("block", "h:b", "p:y"), ("allow", "h:a", "p:y"), ("allow", "h:b", "p:x")}
    assert {(r["verdict"], *r["tokens"]) for r in rules} == pairs
    pages = spark.createDataFrame([(n, u) for n, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = labels_of(spark, [(n, 1, int(label == "block")) for n, (_, label) in enumerate(rows)])
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge_pages(pages, labels).collect()}
    assert got == {n: label for n, (_, label) in enumerate(rows)}
    # and a label that all pages have, which no token can lean towards
    rules = url_rules.mine(spark.createDataFrame([(u, "block") for u, _ in rows], "url string, label string")).collect()
    assert {(r["verdict"], *c) for r in rules for c in itertools.product(*r["parts"])} == {("block", t) for t in ("h:a", "h:b", "h:org", "p:0", "p:x", "p:y")}


def every_rule(rows, least, confidence):
    """Sure combinations of any tokens without a shorter one of their label inside."""
    names = sorted(set().union(*(own for own, _ in rows)))
    pages = {t: frozenset(k for k, (own, _) in enumerate(rows) if t in own) for t in names}
    out = set()
    for label in ("allow", "block"):
        hits, found = {k for k, (_, l) in enumerate(rows) if l == label}, []
        for size in range(1, len(names) + 1):
            for combo in itertools.combinations(names, size):
                on = frozenset.intersection(*(pages[t] for t in combo))
                if len(on & hits) >= least and len(on & hits) / len(on) >= confidence and not any(f < set(combo) for f in found):
                    found.append(set(combo))
                    out.add((label, frozenset(combo), round(len(on & hits) / len(on), 9)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_all_mined_rules_equal_brute_force(spark, seed):
    """Labels by parity of tokens, urls of one token, and query names at random: nothing has to lean."""
    rng = random.Random(seed)
    rows = []
    for n in range(240):
        host, path, query = rng.choice("abc"), rng.choice("xyz"), [q for q in "rstu" if rng.random() < 0.6]
        odd = (host == "a") ^ (path == "x") ^ (seed % 2 == 0 and "r" in query)
        label = "block" if odd ^ (rng.random() < 0.08) else "allow"
        rows.append((n, f"http://{host}/{path}?{'&'.join(query)}#{n}" if n % 9 else f"http://{host}/#{n}", label))
    labelled = spark.createDataFrame(rows, "id int, url string, label string")
    tokens = {r["url"]: set(r["own"]) for r in labelled.select("url", url_rules.url_tokens(F.col("url")).alias("own")).collect()}
    want = every_rule([(tokens[u], l) for _, u, l in rows], 8, 0.75)
    got = expanded(url_rules.mine(labelled.select("url", "label").repartition(3), url_rules.Mining(confidence=0.75, least_pages=8)))
    assert got == want and any(len(f) > 2 for _, f, _ in want)


def test_query_names_at_random_are_mined_in_bounded_time(spark):
    """Forty names, each missing from a few urls of its own, go with no label: their combinations are not tried."""
    rows = []
    for n in range(400):
        names = "&".join(f"t{chr(97 + k // 26)}{chr(97 + k % 26)}=1" for k in range(40) if n % 100 != k)
        rows.append((f"http://{'ab'[n % 2]}.org/{'xy'[n // 2 % 2]}/{n}?{names}", "block" if n % 2 == n // 2 % 2 else "allow"))
    rules = url_rules.mine(spark.createDataFrame(rows, "url string, label string")).collect()
    assert {(r["verdict"], *r["tokens"]) for r in rules} == {("block", "h:a", "p:x"), ("block", "h:b", "p:y"), ("allow", "h:a", "p:y"), ("allow", "h:b", "p:x")}


# --- 4 ----------------------------------------------------------------------------------------


def hits_brute(text, items, window=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
    hit, found = set(), set()
    for name, item in items:
        other = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(item))
        n = min(window, len(other))
        pieces = {tuple(other[i : i + n]) for i in range(len(other) - n + 1)} if other else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in pieces:
                hit |= set(range(i, i + n))
                found |= {name} if name is not None else set()
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_decontamination(spark, docs, no_docs, rows, texts, block_bytes):
    words = [t.split() for t in texts]
    items = [("10", " ".join(words[0][3:40])), ("9", " ".join(words[6])), ("b", "One"), ("c", texts[12].upper()), ("d", ""), ("e", None), (None, texts[18]), ("10", "a b c d"), ("f", " ".join(words[30][:13] + words[36][:12]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontamination.decontaminate(docs, bench, ["doc_id"], block_bytes=block_bytes).select("doc_id", "_op4.*").collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found) == Counter(
        (i, *hits_brute(t, items)[:2], tuple(hits_brute(t, items)[2])) for i, t, _ in rows)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in found)
    assert decontamination.decontaminate(no_docs, bench, ["doc_id"]).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0), ["doc_id"]).filter("_op4.n_hit > 0").count() == 0


# --- 5 ----------------------------------------------------------------------------------------


def test_toxicity_finds_held_out_rows(spark, no_docs):
    rng = random.Random(2)
    plain = [f"word{n}" for n in range(300)]
    rows, labels = [], []
    for n in range(1500):
        words = [rng.choice(plain) for _ in range(rng.choice((3, 10, 30)))]
        bad = n % 6 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(("Idiot!", "scumling", "scumster", "scumoid"))
        rows.append((n, " ".join(words), "s"))
        labels.append((n, 1, int(bad)))
    docs = table(spark, rows + [(5000, None, None), (5001, "", "s"), (None, "idiot", "s"), (5002, "word1 scumling word2", "s"), (5003, "word1 scumful word2", "s")], extra=True)
    machine = toxicity.fit(docs, labels_of(spark, labels + [(None, 1, 1), (7, None, None)]))
    got = {r["doc_id"]: r for r in toxicity.score(docs, machine, ["doc_id"]).withColumn("held", toxicity.held_out()).collect()}
    assert {i for i, r in got.items() if i is not None and r["held"]} == {i for i in got if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    held = [(r["_op5"] >= toxicity.PREDICT_AT, i % 6 == 0) for i, r in got.items() if i is not None and i < 1500 and r["held"]]
    assert sum(p == t for p, t in held) >= 0.98 * len(held)
    assert got[5002]["_op5"] >= toxicity.PREDICT_AT and got[5003]["_op5"] > max(got[5000]["_op5"], got[5001]["_op5"])
    assert toxicity.score(no_docs, machine, ["doc_id"]).count() == 0
    one = toxicity.fit(docs, labels_of(spark, [(n, 1, 0) for n in range(50)]))
    assert toxicity.score(docs, one, ["doc_id"]).agg(F.max("_op5")).first()[0] < 1e-6


def test_toxicity_query_scores_as_a_machine_written_out(spark, tmp_path, monkeypatch):
    """Three features with known weights; every score of the query worked out one text at a time."""
    hashes = [int(toxicity.terms_of(pa.array([word]))[0][at]) for word, at in (("idiot", 0), ("scumxx", 1), ("folk", 0))]
    order = np.argsort(np.array(hashes, np.uint64))
    weights, factors = np.array([0.5, 0.4, -0.2]), np.array([[1.0, 0.5], [0.3, -0.7], [2.0, 1.5]])
    machine = toxicity.Machine(np.array(hashes, np.uint64)[order], weights[order], factors[order], -1.0, slope=2.0, shift=0.25)
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: machine)
    texts = ["idiot", "IDIOT folk", "idiot idiot, scumling", "scum", "scumber folk", "folk", "a plain text", "", None, "idiot scummy folk " * 900]
    table(spark, [(n, t, "s") for n, t in enumerate(texts)], extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.op5_toxicity(spark, str(tmp_path)).collect()}
    for n, text in enumerate(texts):
        words = fold(text).replace(",", "").split()
        here = [k for k, has in enumerate(("idiot" in words, any(w.startswith("scum") and len(w) > 4 for w in words), "folk" in words)) if has]
        margin = -1.0 + sum(weights[k] for k in here) + sum(float(factors[a] @ factors[b]) for a, b in itertools.combinations(here, 2))
        score = 1 / (1 + math.exp(-(2.0 * math.copysign(math.log1p(abs(margin)), margin) + 0.25)))
        assert abs(got[n]["score"] - score) < 1e-8 and got[n]["predicted"] == int(score >= 0.7), text
        assert got[n]["held_out"] == (zlib.crc32(str(n).encode()) % 3 == 1)


def test_machine_margin_is_pairwise():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(np.arange(6, dtype=np.uint64), rng.normal(size=6), rng.normal(size=(6, 3)), 0.3)
    want = 0.3 + m.weights[[1, 3, 4]].sum() + sum(m.factors[a] @ m.factors[b] for a, b in ((1, 3), (1, 4), (3, 4)))
    assert np.isclose(m.margins(np.zeros(3, np.int64), np.array([1, 3, 4]), 1)[0], want)


# --- 6 ----------------------------------------------------------------------------------------


def removal_brute(rows, window):
    words = {r: re.findall(SPACE_WORDS, r[1] or "") for r in set(rows)}
    least = {}
    for (i, _), w in words.items():
        for n in range(len(w) - window + 1) if i is not None else ():
            s = tuple(w[n : n + window])
            least[s] = min(least.get(s, i), i)
    out = {}
    for (i, t), w in words.items():
        gone = {n + j for n in range(len(w) - window + 1) if i is not None and least[tuple(w[n : n + window])] < i for j in range(window)}
        out[i, t] = len(w), len(gone), hashlib.sha256(" ".join(x for n, x in enumerate(w) if n not in gone).encode()).hexdigest()
    return out


@pytest.mark.parametrize("window,k,group_bytes", [(50, 8, 1 << 24), (6, 2, 1 << 24), (6, 2, 200), (5, 5, 1 << 24)])
def test_substring_dedup(docs, no_docs, rows, window, k, group_bytes):
    want = removal_brute([(i, t) for i, t, _ in rows], window)
    got = substring_dedup.remove_passages(docs, window, k, group_bytes).drop("row").collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *want[i, t]) for i, t, _ in rows)
    assert substring_dedup.remove_passages(no_docs, window, k).count() == 0


# --- 7 ----------------------------------------------------------------------------------------


def test_line_dedup(spark, no_docs):
    rows = []
    for n in range(60):
        lines = [f"own line {n}", "  everywhere \t", f"on {n % 12} of many", "" if n % 2 else " ", f"nine {n}" if n % 12 > 8 else "nine", "ten" if n % 12 < 10 else "other"]
        rows.append((n + 10, "\n".join(lines), f"s{n % 12}"))
    rows += [(3, None, "s1"), (4, "", "s1"), (None, "everywhere\nten", "s2"), (5, "everywhere", None), rows[0], (80, "everywhere", "s1")]
    docs = table(spark, rows, extra=True).repartition(4)
    sites, first = defaultdict(set), {}
    blank = line_dedup.BLANK
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            x = x.strip(blank)
            if x and s is not None:
                sites[x].add(s)
                first[x] = min(first.get(x, i if i is not None else 10**9), i if i is not None else 10**9)
    def kept(i, t):
        if t is None:
            return None
        out = [x for x in t.split("\n") if not (x.strip(blank) and len(sites[x.strip(blank)]) >= 10 and (i is None or i > first[x.strip(blank)]))]
        return "\n".join(out)
    got = Counter((r["doc_id"], r["text"], r["_kept"]) for r in line_dedup.remove_boilerplate(docs).collect())
    assert got == Counter((i, t, kept(i, t)) for i, t, _ in rows)
    assert line_dedup.remove_boilerplate(no_docs).count() == 0


# --- 8 ----------------------------------------------------------------------------------------


def pick(key, level, path, weights):
    def draw(n):
        h = int(hashlib.md5(f"{'null' if key is None else key}/{level}/{path}/{n}".encode()).hexdigest()[:13], 16)
        return -math.log((h + 1) / 2**52) / weights[n] if weights[n] > 0 else math.inf
    return min(range(len(weights)), key=lambda n: (draw(n), n))


def test_sharding(docs, no_docs, rows, spark):
    tree = [[[1.0, 2.0], [1.0]], [[0.0, 3.0], [1.0, 1.0, 1.0]], [[2.0]]]
    first = np.cumsum([0] + [len(k) for r in tree for k in r])
    def shard(key, tree):
        r = pick(key, "region", "", [sum(map(sum, x)) for x in tree])
        k = pick(key, "rack", r, [sum(x) for x in tree[r]])
        return int(np.cumsum([0] + [len(x) for y in tree for x in y])[sum(map(len, tree[:r])) + k]) + pick(key, "shard", f"{r}/{k}", tree[r][k])
    got = sharding.shard_rows(docs, tree).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), shard(i, tree), shard(i, sharding.grow(tree))) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r["grown_shard"] in (r["shard"], int(first[-1])) for r in got)
    assert sharding.shard_rows(no_docs, tree).count() == 0
    # weights: shares follow them, and a heavier rack draws rows only into its own region
    many = spark.range(6000).select(F.col("id").alias("doc_id"))
    heavier = [[[1.0, 2.0], [4.0]], *tree[1:]]
    moved = many.select(sharding.assign(F.col("doc_id"), tree).alias("a"), sharding.assign(F.col("doc_id"), heavier).alias("b")).collect()
    assert all(r["b"] < 3 for r in moved if r["a"] != r["b"]) and any(r["a"] != r["b"] for r in moved)
    share = Counter(r["a"] for r in moved)
    assert share[3] == 0 and abs(share[4] / 6000 - 3 / 12) < 0.03


# --- 9 ----------------------------------------------------------------------------------------


def test_cotraining(spark, no_docs):
    rng = random.Random(3)
    rows, labels = [], []
    for n in range(900):
        bad = n % 4 == 0
        words = [rng.choice("alpha beta gamma delta".split()) + ("$$$" if bad and rng.random() < 0.4 else "") for _ in range(25)]
        rows.append((n, (" " if bad else "\n").join(words), "junk" if bad and n % 3 else "site"))
        labels += [(n, int(not bad), 0)] if n % 2 == 0 or n % 7 == 0 else []
    docs = table(spark, rows + [(5000, None, None), (None, "alpha", "site")], extra=True)
    model = cotraining.co_train(docs, labels_of(spark, labels + [(None, 1, 0), (1, None, 0)]))
    got = {r["doc_id"]: r["_op9"] for r in cotraining.score(docs, model, ["doc_id"]).collect()}
    rest = [n for n in range(900) if not (n % 2 == 0 or n % 7 == 0)]
    assert sum((got[n]["score"] >= 0.5) == (n % 4 != 0) for n in rest) >= 0.97 * len(rest)
    assert all(0 <= v <= 1 for r in got.values() for v in r) and len(got) == 902
    assert cotraining.score(no_docs, model, ["doc_id"]).count() == 0
    none = cotraining.co_train(docs, labels_of(spark, []))
    assert {r["_op9"]["score"] for r in cotraining.score(docs, none, ["doc_id"]).collect()} == {0.5}


def test_cotraining_lends_sure_labels_to_the_other_view(spark, monkeypatch):
    """The rows of every fit, against margins worked out from the models of the round before."""
    rng = random.Random(12)
    rows, labels = [], []
    for n in range(160):
        good = n % 2 == 0
        words = [rng.choice(("fine", "clear", "true") if good == (rng.random() < 0.85) else ("spam", "junk", "buy")) for _ in range(12)]
        rows.append((n, " ".join(words), f"site{'ab'[good == (rng.random() < 0.85)]}"))
        labels += [(n, int(good), 0)] if n < 60 else []
    docs, known = table(spark, rows), labels_of(spark, labels)
    fits, plain = [], cotraining._fit

    def spy(rows, view, *more):
        model = plain(rows, view, *more)
        if view != "m":
            fits.append((view, Counter((r["doc_id"], r["label"]) for r in rows.select("doc_id", "label").collect()), model))
        return model

    monkeypatch.setattr(cotraining, "_fit", spy)
    cotraining.co_train(docs, known, rounds=2, sure=0.8)
    frame = cotraining.samples(docs, known).collect()
    pool = [r for r in frame if r["label"] is None]
    assert [v for v, _, _ in fits] == ["text", "meta"] * 3 and len(pool) == 100
    own = fits[0][1]
    assert own == fits[1][1] and {i for i, _ in own} < set(range(60)) and all(label == (i % 2 == 0) for i, label in own)
    edge = math.log(0.8 / 0.2)
    lent_any = 0
    for at in range(2, 6):
        view, trained, _ = fits[at]
        other, _, model = next(f for f in reversed(fits[: at - at % 2]) if f[0] != view)
        margins = {r["doc_id"]: float(model.coefficients.dot(r[other]) + model.intercept) for r in pool}
        lent = Counter((i, float(m > 0)) for i, m in margins.items() if abs(m) >= edge)
        assert trained == own + lent, (at, view)
        lent_any += len(lent)
    assert lent_any > 50


def test_cotraining_judges_every_unlabelled_document(spark):
    ids = spark.range(14_000).select("id", F.when(F.col("id") > 0, F.col("id")).alias("doc_id"))
    docs = ids.select("doc_id", F.concat(F.lit("w"), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(3).cast("long").alias("n_chars"))
    labels = labels_of(spark, [(n, n % 2, 0) for n in range(1, 101)])
    frame = cotraining.samples(docs, labels, labelled_rows=60)
    got = {r["doc_id"]: r["label"] for r in frame.select("doc_id", "label").collect()}
    assert frame.filter("label is null").count() == 13_900 and set(range(101, 14_000)) | {None} == {i for i, v in got.items() if v is None}
    assert len(got) == 13_960 and all(v == i % 2 for i, v in got.items() if v is not None)


@pytest.mark.parametrize("bad", [1, 2])
def test_cotraining_learns_from_few_labels_of_a_class(spark, bad):
    docs = table(spark, [(n, f"{'junk $$' if n < 10 else 'fine words'} w{n}", "site") for n in range(40)])
    labels = labels_of(spark, [(n, int(n >= bad), 0) for n in [*range(bad), *range(20, 26)]])
    model = cotraining.co_train(docs, labels, rounds=1)
    got = {r["doc_id"]: r["_op9"]["score"] for r in cotraining.score(docs, model, ["doc_id"]).collect()}
    assert max(got[n] for n in range(10)) < min(got[n] for n in range(10, 40))


# --- 10 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("capacity,group_pieces", [(4096, 32768), (64, 40)])
def test_packing(docs, no_docs, rows, capacity, group_pieces):
    tokenizer = packing.WordTokenizer(packing.public_vocabulary()).tokenizer
    want = Counter()
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            cut = ids[start : start + capacity]
            want[i, piece, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    got = packing.pack_documents(docs, packing.public_vocabulary(), capacity, group_pieces=group_pieces).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    full = defaultdict(list)
    for r in got:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in full.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0] + [n for _, n in places])[:-1].tolist() and sum(n for _, n in places) <= capacity
    total = sum(r["length"] for r in got)
    assert len(full) <= -(-total // capacity) + max(2, total // capacity // 10)
    assert packing.pack_documents(no_docs, packing.public_vocabulary()).count() == 0


def has_exchange(lengths, bin_of, capacity):
    """Whether any underfull bin can give one or two pieces, for one or none back, and raise the sum of squared fills."""
    fill = np.bincount(bin_of, weights=lengths).astype(int)
    open_bins = [b for b in range(len(fill)) if 0 < fill[b] < capacity]
    for donor in open_bins:
        own = lengths[bin_of == donor].tolist()
        for s in own + [x + y for n, x in enumerate(own) for y in own[:n]]:
            for to in open_bins:
                if to != donor and any(0 < s - y <= capacity - fill[to] and fill[to] - fill[donor] + s - y > 0 for y in [0, *lengths[bin_of == to].tolist()]):
                    return True
    return False


def test_swaps_end_without_an_exchange_left():
    rng = np.random.default_rng(7)
    for n in range(20):
        lengths = rng.integers(1, 40, 60)
        start = packing.best_fit(lengths, 64) if n % 2 else np.arange(60)
        assert not has_exchange(lengths, packing.swap_search(lengths, start, 64), 64)
    # more pieces than 2,000 steps can place, and more stuck bins than 64
    lengths = np.concatenate((np.full(70, 35), np.ones(5000, int)))
    done = packing.swap_search(lengths, np.arange(len(lengths)), 64)
    assert len(np.unique(done)) == -(-lengths.sum() // 64)


def test_swaps_raise_squared_fill_and_empty_bins():
    lengths = np.array([6, 4, 5, 5, 3, 3, 2, 2])
    start = np.arange(8)
    done = packing.swap_search(lengths, start, 10)
    fill = np.bincount(done, weights=lengths)
    assert fill.max() <= 10 and (fill > 0).sum() == 3 and (fill**2).sum() > (lengths**2).sum()
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = rng.integers(1, 40, 60)
        start = np.arange(60)
        done = packing.swap_search(lengths, start, 64)
        fill = np.bincount(done, weights=lengths)
        assert fill.max() <= 64 and (fill > 0).sum() <= -(-lengths.sum() // 64) + 3


def test_units_match_the_tokenizer_for_any_text(texts):
    encoder = packing.WordTokenizer(packing.public_vocabulary(), limit=50)
    more = [*texts, "it's IT'S 'LL don't", "É é e\u0301 × ÷ ß ﬁ ª²½", "\x00\x01\x1c\x7f a", "<|ENDOFTEXT|> <|endoftext|>x", "ΑΣ ας 中文 1२3", "a\u00adb \u0085 c", "日本 語\u3000x"]
    ids, begin = encoder.encode(pa.array(more))
    for n, t in enumerate(more):
        assert ids[begin[n] : begin[n + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
