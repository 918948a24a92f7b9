"""The pipeline stage by stage against brute force, on the smallest table."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline
from test_llm_operators import components_brute, hits_brute

from motoquant.llm import line_dedup
from motoquant.llm.registry import QUERIES
from motoquant.llm.store import settle


def test_stages_do_what_they_say(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name, "in"] = docs
        docs = out[name] = settle(stage(spark, docs, sf_dir), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == out[corpus_pipeline.STAGES[0][0], "in"].columns
    rows = lambda df: Counter(tuple(r) for r in df.collect())

    kept = {r["doc_id"] for r in QUERIES["op1_quality_rules"](spark, sf_dir).filter("kept").collect()}
    given = out["quality_rules", "in"].collect()
    assert 0 < len(kept) < len(given) and rows(out["quality_rules"]) == Counter(tuple(r) for r in given if r["doc_id"] in kept)

    sites, first = defaultdict(set), {}
    given = out["line_dedup", "in"].collect()
    for r in sorted(given, key=lambda r: r["doc_id"]):
        for x in (x.strip(line_dedup.BLANK) for x in r["text"].split("\n")):
            sites[x].add(r["source"])
            first.setdefault(x, r["doc_id"])
    def lines(r):
        whole = r["text"].split("\n")
        rest = [x for x in whole if not (len(sites[x.strip(line_dedup.BLANK)]) >= line_dedup.MIN_SITES and x.strip(line_dedup.BLANK) and r["doc_id"] > first[x.strip(line_dedup.BLANK)])]
        return tuple(r) if rest == whole else (r["doc_id"], "\n".join(rest), r["lang"], r["source"], len("\n".join(rest)))
    assert rows(out["line_dedup"]) == Counter(map(lines, given))

    given = out["near_duplicates", "in"].collect()
    groups = components_brute([(r["doc_id"], r["text"]) for r in given], 5, 80, 100)
    assert rows(out["near_duplicates"]) == Counter(tuple(r) for r in given if groups[r["doc_id"], r["text"]][1] == r["doc_id"])

    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    def clean(r):
        words, hit, _ = hits_brute(r["text"], items)
        return not (hit and 20 * hit >= words)
    assert rows(out["decontamination"]) == Counter(tuple(r) for r in out["decontamination", "in"].collect() if clean(r))

    ids = {r["doc_id"] for r in out["packing", "in"].collect()}
    assert {r["doc_id"] for r in out["packing"].collect()} == ids
    assert rows(corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "start", "length", "ids_crc32")) == rows(
        out["packing"].select("doc_id", "piece", "start", "length", "ids_crc32"))


def test_stages_take_empty_and_odd_tables(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    for rows in ([], [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b", "en", "s", 3), (2, "a b", "en", "s", 3)]):
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(rows, schema)
            assert stage(spark, docs, sf_dir).count() in ((0,) if not rows else range(5)), name


CLASHES = ("_row", "_op1", "_op4", "_kept", "_removed", "_dropped", "carried", "row", "group", "set", "key", "good", "label")


def odd_documents(spark, rows):
    """Documents with a column for every name that the stages use inside."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *[f"{c}{n}" for c in CLASHES]) for n, (i, t, s) in enumerate(rows)], kinds)


def test_one_row_of_each_group_stays(spark, sf_dir):
    words = [f"w{k}" for k in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "changed"]), " ".join(reversed(words))
    rows = [(1, text, "a"), (1, text, "b"), (2, text, "c"), (None, text, "d"), (None, near, "e"), (None, near, "e"), (2, near, "f")]
    rows += [(None, other, "g"), (None, other, "h"), (7, "", "i"), (7, "", "j"), (8, "", "k"), (None, None, "l"), (None, None, "m"), (9, None, "n"), (7, other + " x", "o")]
    docs = odd_documents(spark, rows)
    out = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert out.columns == docs.columns
    got = out.collect()
    assert not Counter(tuple(r) for r in got) - Counter(tuple(r) for r in docs.collect())
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(1, text), (7, other + " x"), (7, ""), (8, ""), (None, None), (9, None)])


def test_stages_leave_columns_of_clashing_names_alone(spark, sf_dir):
    common = "this line stands on many sites and says nothing of its own"
    rng = random.Random(3)
    rows = [(n, "\n".join([" ".join(rng.choice("abcdefgh") * rng.randrange(1, 6) + str(rng.randrange(90)) for _ in range(40)), common]), f"s{n}") for n in range(14)]
    docs = odd_documents(spark, rows + [(None, None, "s1"), (50, "", None)])
    given = {r["_row"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema.names == docs.columns, name
        for r in out.collect():
            before = given[r["_row"]]
            assert [r[c] for c in ("doc_id", "source", *CLASHES)] == [before[c] for c in ("doc_id", "source", *CLASHES)], name
            if name == "line_dedup":
                gone = r["doc_id"] is not None and 0 < r["doc_id"] < 14
                assert r["text"] == (before["text"].removesuffix("\n" + common) if gone else before["text"]) and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
            else:
                assert r["text"] == before["text"] and r["n_chars"] == before["n_chars"]
    assert corpus_pipeline.pack(spark, docs, sf_dir).filter("doc_id = 3").count() == 1


def test_stages_take_a_text_of_a_million_words(spark, sf_dir):
    long = " ".join(str(k * k % 1_000_003) for k in range(1_000_000))
    docs = spark.createDataFrame([(10**9 + 1, long, "en", "s", len(long)), (10**9 + 2, "a short text of some eleven words stands here beside it", "en", "t", 55)], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {10**9 + 1, 10**9 + 2}, name
