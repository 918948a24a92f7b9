"""Removal of repeated word passages by prefix-partitioned suffix trees (operator 6).

A window is ``window`` consecutive words. Windows are grouped by a content-defined prefix: the least of
their k-grams, its anchor. Only anchors that occur in several documents go on; their windows are cut out
as segments, equal segments are merged, and segments of one prefix meet in one task. There a suffix
array over word ranks, doubled up to the window's length, gives the subtree's nodes of that depth: a
node is a passage that repeats, and the least document below it keeps it. Prefix groups beyond
``GROUP_BYTES`` are split by the longest prefix, the whole window, whose subtrees are single nodes.

Each word of a window that also starts in a document of smaller id is removed. Windows are judged on the
input. Null texts have no words. Rows with equal id and text are one document and get equal results;
rows of equal id and different texts do not affect each other; a null id neither removes nor keeps.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motoquant.llm.store import row_key, settle, table
from motoquant.llm.words import NOT_SPACE, annotate, chunks, least_grams, lists, runs_to_mask, window_hashes, winnow, words_of

WINDOW = 50
K = 8
GROUP_BYTES = 16 << 20  # segments of one prefix that a task holds
BATCH_BYTES = 2 << 20  # segments of whole prefixes that share a suffix array


def _words(text: bytes) -> list[bytes]:
    return text.split()


def scan(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Row key, id, words, digest of all words, and hash and place of every anchor."""
    rows = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def start():
        def step(piece: pa.RecordBatch) -> list:
            words = words_of(piece.column("text"), NOT_SPACE)
            hashes = words.hashes()
            places = winnow(hashes, words.first, k, window)
            owner = np.searchsorted(words.first, places, "right") - 1
            per_row = np.bincount(owner, minlength=piece.num_rows)
            digests = [hashlib.sha256(b" ".join(_words((t or "").encode()))).hexdigest() for t in piece.column("text").to_pylist()]
            anchors = pa.StructArray.from_arrays([pa.array(window_hashes(hashes, places, k).view(np.int64)), pa.array((places - words.first[owner]).astype(np.int32))], ["prefix", "place"])
            return [words.counts, digests, lists(anchors, per_row)]
        return step

    return annotate(rows, ["row", "doc_id"], "n_words long, sha256 string, anchors array<struct<prefix: long, place: int>>", start)


def segments(repeated: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Windows of each surviving anchor as one run of words: its first word's place and its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            words = words_of(piece.column("text"), NOT_SPACE)
            hashes = words.hashes()
            begin, place = least_grams(hashes, words.first, k, window)
            chosen = piece.column("places")
            counts = chosen.value_lengths().fill_null(0).to_numpy()
            base = np.repeat(words.first[:-1], counts)
            anchor = np.sort(chosen.flatten().to_numpy().astype(np.int64) + base)
            low, high = np.searchsorted(place, anchor, "left"), np.searchsorted(place, anchor, "right")
            row = np.searchsorted(words.first, anchor, "right") - 1
            a, b = begin[low], begin[high - 1]
            last = words.ends[b + window - 1]
            texts = [b" ".join(_words(words.buffer[s:e].tobytes())) for s, e in zip(words.starts[a], last)]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [piece.column("row").take(at), piece.column("doc_id").take(at), pa.array((a - words.first[row]).astype(np.int32)),
                 pa.array(window_hashes(hashes, anchor, k).view(np.int64)), pa.array(texts, pa.binary()).cast(pa.string())],
                ["row", "doc_id", "at", "prefix", "segment"],
            )

    return repeated.mapInArrow(run, "row long, doc_id long, at int, prefix long, segment string")


def window_ranks(words: np.ndarray, window: int) -> np.ndarray:
    """Order of the suffixes by their first ``window`` words; equal for equal windows.

    Places whose window runs past the end get an order that nobody reads.
    """
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < window:
        shift = min(length, window - length)
        ahead = np.append(rank[shift:], np.zeros(shift, np.int64))[: len(rank)]
        rank = np.unique(rank * np.int64(len(rank) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        length += shift
    return rank


def deep_nodes(texts: pa.Array, least: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, window and least document of every window of the segments."""
    words = words_of(texts, NOT_SPACE)
    at = words.windows(window)
    if not len(at):
        return at, at, at
    node = window_ranks(words.hashes(), window)[at]
    segment = words.text[at]
    order = np.argsort(node, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(node[order]) > 0)))
    below = np.minimum.reduceat(least[segment][order], edges)
    lowest = np.empty(len(at), np.int64)
    lowest[order] = np.repeat(below, np.diff(np.append(edges, len(at))))
    return segment, at - words.first[segment], lowest


RUNS = "s1 long, s2 long, begin int, end int, keeper long"


def _runs(batch: pa.Table, window: int) -> pa.RecordBatch:
    """Ranges of windows of each segment with one keeper that is smaller than some holder's id."""
    least = batch.column("least").to_numpy()
    segment, at, keeper = deep_nodes(batch.column("segment").combine_chunks(), least, window)
    taken = keeper < batch.column("most").to_numpy()[segment]
    segment, at, keeper = segment[taken], at[taken], keeper[taken]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(segment) != 0) | (np.diff(at) != 1) | (np.diff(keeper) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    names = [batch.column(x).combine_chunks().take(pa.array(segment[first])) for x in ("s1", "s2")]
    return pa.RecordBatch.from_arrays(
        [*names, pa.array(at[first].astype(np.int32)), pa.array((at[last] + 1).astype(np.int32)), pa.array(keeper[first])],
        ["s1", "s2", "begin", "end", "keeper"],
    )


def subtrees(distinct: DataFrame, window: int = WINDOW) -> DataFrame:
    """Runs from the suffix arrays of whole prefix groups, several small groups at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chunks(batches, "segment", BATCH_BYTES):
            held.append(batch)
            if sum(b.column("segment").nbytes for b in held) < BATCH_BYTES:
                continue
            whole = pa.Table.from_batches(held)
            prefix = whole.column("prefix").to_numpy()
            cut = int(np.flatnonzero(prefix != prefix[-1])[-1]) + 1 if (prefix != prefix[-1]).any() else 0
            if cut:
                yield _runs(whole.slice(0, cut), window)
                held = whole.slice(cut).combine_chunks().to_batches()
        if held:
            yield _runs(pa.Table.from_batches(held), window)

    return distinct.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, RUNS)


def whole_windows(distinct: DataFrame, window: int = WINDOW) -> DataFrame:
    """Runs of segments whose prefix is too frequent: windows are the prefixes, by two hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "segment"):
            words = words_of(piece.column("segment"), NOT_SPACE)
            at = words.windows(window)
            row = words.text[at]
            keys = [pa.array(window_hashes(words.hashes(seed), at, window).view(np.int64)) for seed in (0, 1)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(x).take(take) for x in ("s1", "s2", "least", "most")), pa.array((at - words.first[row]).astype(np.int32)), *keys],
                ["s1", "s2", "least", "most", "begin", "w1", "w2"],
            )

    windows = distinct.mapInArrow(run, "s1 long, s2 long, least long, most long, begin int, w1 long, w2 long")
    keepers = windows.groupBy("w1", "w2").agg(F.min("least").alias("keeper"))
    found = windows.join(keepers, ["w1", "w2"]).filter("keeper < most")
    return found.select("s1", "s2", "begin", (F.col("begin") + 1).cast("int").alias("end"), "keeper")


def repeated_passages(docs: DataFrame, window: int = WINDOW, k: int = K, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents scanned; those with repeated anchors; and removed word ranges by row key."""
    scanned = settle(scan(docs, window, k), "scanned")
    anchors = scanned.filter("doc_id is not null").select("row", "doc_id", F.inline("anchors"))
    again = anchors.groupBy("prefix").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("prefix")
    places = anchors.join(again, "prefix").groupBy("row").agg(F.collect_set("place").alias("places"))
    rows = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = settle(rows.join(places, "row"), "repeated")

    held = segments(repeated, window, k).withColumns({"s1": F.xxhash64("segment"), "s2": F.xxhash64(F.lit(1), "segment")})
    held = settle(held, "segments")
    distinct = held.groupBy("s1", "s2").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.any_value("prefix").alias("prefix"), F.any_value("segment").alias("segment"),
    )
    distinct = settle(distinct, "distinct-segments")
    large = distinct.groupBy("prefix").agg(F.sum(F.octet_length("segment")).alias("size")).filter(F.col("size") > group_bytes).select("prefix")
    large = settle(large, "large-prefixes")
    if large.limit(1).count():
        runs = subtrees(distinct.join(large, "prefix", "left_anti"), window).unionByName(whole_windows(distinct.join(large, "prefix", "left_semi"), window))
    else:
        runs = subtrees(distinct, window)
    spans = held.select("row", "doc_id", "at", "s1", "s2").join(settle(runs, "runs"), ["s1", "s2"]).filter("keeper < doc_id")
    spans = spans.select("row", F.struct((F.col("at") + F.col("begin")).alias("start"), (F.col("at") + F.col("end") + (window - 1)).alias("end")).alias("span"))
    return scanned, repeated, spans.groupBy("row").agg(F.collect_set("span").alias("spans"))


def remove_passages(docs: DataFrame, window: int = WINDOW, k: int = K, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``row``, doc_id, words, removed words and digest of the kept words of every document."""
    scanned, repeated, spans = repeated_passages(docs, window, k, group_bytes)
    cut = repeated.select("row", "text").dropDuplicates(["row"]).join(spans, "row")

    def start():
        def step(piece: pa.RecordBatch) -> list:
            removed, digests = [], []
            for text, spans in zip(piece.column("text").to_pylist(), piece.column("spans").to_pylist()):
                words = _words(text.encode())
                gone = runs_to_mask(len(words), np.array([s["start"] for s in spans]), np.array([s["end"] for s in spans]))
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist()) if not g)).hexdigest())
            return [removed, digests]
        return step

    done = annotate(cut, ["row"], "n_removed long, kept string", start, read=["spans"])
    found = scanned.select("row", "doc_id", "n_words", "sha256").join(done, "row", "left")
    return found.select("row", "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "sha256").alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents")).drop("row")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT s, min(doc_id) AS least FROM v GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM v JOIN m USING (s) WHERE doc_id > least),
kept AS (
    SELECT p.doc_id, count(*) FILTER (g.j IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY p.j) FILTER (g.j IS NULL) AS t
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.j = g.j GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
