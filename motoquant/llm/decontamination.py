"""Benchmark decontamination by winnowing (operator 4).

Both sides keep the smallest k-gram hash of every ``window - k + 1`` consecutive k-grams, so any
shared span of ``window`` words shares a kept fingerprint. Document fingerprints are joined with
those of the benchmark and each hit is extended to the whole shared span; spans of at least
``window`` words count. An item shorter than a window is one window and is looked up at every
position.

The benchmark is the query set: it is cut into blocks of bounded size, each sent to all tasks, and
every document meets every block. A benchmark within one block takes one pass over the documents.

Null texts have no words, items without words match nothing, null item ids never appear in the list
of items, repeated items count once, repeated documents are judged once each. An empty benchmark
leaves all documents clean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motoquant.llm.store import table
from motoquant.llm.words import LETTER, LOWER, annotate, lists, mask_to_runs, runs_to_mask, sums, window_hashes, winnow, words_of

K = 8
WINDOW = 13
BLOCK_BYTES = 16 << 20  # benchmark text sent to the tasks at once
PAIRS_AT_ONCE = 1 << 20


@dataclass
class Block:
    """Items of one block: word hashes end to end, fingerprints in order, and short items by length."""

    names: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    prints: np.ndarray
    places: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]
    k: int
    window: int


def build_block(names: list[str], texts: list[str], k: int = K, window: int = WINDOW) -> Block:
    words = words_of(pa.array(texts, pa.string()), LETTER, LOWER)
    hashes, counts = words.hashes(), words.counts
    places = winnow(hashes, words.first, k, window)
    prints = window_hashes(hashes, places, k)
    order = np.argsort(prints, kind="stable")
    short = {}
    for n in sorted(set(counts[(counts > 0) & (counts < window)].tolist())):
        items = np.flatnonzero(counts == n)
        whole = window_hashes(hashes, words.first[items], n)
        by = np.argsort(whole, kind="stable")
        short[n] = (whole[by], items[by])
    return Block(np.array(names, object), hashes, words.first, prints[order], places[order], short, k, window)


def _pairs(found: np.ndarray, values: np.ndarray, sought: np.ndarray):
    """Positions of ``found`` with every index of ``values`` that is equal, in slices."""
    low, high = np.searchsorted(values, sought, "left"), np.searchsorted(values, sought, "right")
    hit = np.flatnonzero(high > low)
    sizes = (high - low)[hit]
    done = 0
    while done < len(hit):
        to = max(done + 1, int(np.searchsorted(np.cumsum(sizes[done:]), PAIRS_AT_ONCE, "right")) + done)
        part, size = hit[done:to], sizes[done:to]
        ends = np.cumsum(size)
        yield np.repeat(found[part], size), np.repeat(low[part] - (ends - size), size) + np.arange(ends[-1])
        done = to


def match(hashes: np.ndarray, first: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shared spans: start and end among the documents' words, document, and item."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    item_of = np.repeat(np.arange(len(block.first) - 1), np.diff(block.first))
    found: list[tuple] = []
    kept = winnow(hashes, first, block.k, block.window)
    for p, index in _pairs(kept, block.prints, window_hashes(hashes, kept, block.k)):
        q = block.places[index]
        item = item_of[q]
        left = _agree(hashes, p - 1, first[doc[p]], block.hashes, q - 1, block.first[item], -1)
        right = _agree(hashes, p, first[doc[p] + 1] - 1, block.hashes, q, block.first[item + 1] - 1, 1)
        long = left + right >= block.window
        found.append(((p - left)[long], (p + right)[long], doc[p][long], item[long]))
    last = np.repeat(first[1:], np.diff(first))
    for n, (values, items) in block.short.items():
        at = np.flatnonzero(np.arange(len(hashes)) + n <= last)
        for p, index in _pairs(at, values, window_hashes(hashes, at, n)):
            found.append((p, p + n, doc[p], items[index]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(column) for column in zip(*found))


def _agree(a: np.ndarray, p: np.ndarray, a_end: np.ndarray, b: np.ndarray, q: np.ndarray, b_end: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from each pair of positions on, up to the ends of both texts."""
    room = np.minimum((a_end - p) * step, (b_end - q) * step) + 1
    length = np.zeros(len(p), np.int64)
    live = np.flatnonzero(room > 0)
    while len(live):
        at = length[live] * step
        live = live[a[p[live] + at] == b[q[live] + at]]
        length[live] += 1
        live = live[length[live] < room[live]]
    return length


FIELDS = "_op4 struct<n_words: long, n_hit: long, spans: array<struct<start: long, end: long>>, items: array<string>>"


def _match_block(docs: DataFrame, keep: list[str], block: Block, earlier: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def start():
        block = shared.value
        named = np.array([x is not None for x in block.names], bool)

        def step(piece: pa.RecordBatch) -> list:
            words = words_of(piece.column("text"), LETTER, LOWER)
            begin, end, doc, item = match(words.hashes(), words.first, block)
            items = [[] for _ in range(piece.num_rows)]
            for d, i in sorted(set(zip(doc.tolist(), item.tolist()))):
                if named[i]:
                    items[d].append(block.names[i])
            if earlier:
                for d, before in enumerate(piece.column("_op4").to_pylist()):
                    items[d] += before["items"]
                    for span in before["spans"]:
                        begin = np.append(begin, words.first[d] + span["start"])
                        end = np.append(end, words.first[d] + span["end"])
            hit = runs_to_mask(len(words.starts), begin, end)
            low, high = mask_to_runs(hit)
            border = words.first[1:-1]
            border = np.unique(border[(border > 0) & (border < len(hit))])
            border = border[hit[border] & hit[border - 1]]  # spans end with their document
            low, high = np.union1d(low, border), np.union1d(high, border)
            row = np.searchsorted(words.first, low, "right") - 1
            base = words.first[row]
            spans = pa.StructArray.from_arrays([pa.array(low - base, pa.int64()), pa.array(high - base, pa.int64())], ["start", "end"])
            per_row = np.bincount(row, minlength=piece.num_rows)
            items = [sorted(set(x)) for x in items]
            return [pa.StructArray.from_arrays(
                [pa.array(words.counts, pa.int64()), pa.array(sums(hit, words.first), pa.int64()),
                 lists(spans, per_row), pa.array(items, pa.list_(pa.string()))],
                ["n_words", "n_hit", "spans", "items"],
            )]

        return step

    return annotate(docs, keep, FIELDS, start, read=["_op4"] if earlier else [])


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], k: int = K, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The kept columns and ``_op4``: words, hit words, hit spans (in words) and the items found.

    Needs 1 <= k <= window.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for n in range(blocks):
        rows = dealt.filter(F.col("block") == n).collect()
        block = build_block([r["item_id"] for r in rows], [r["text"] for r in rows], k, window)
        carried = keep if n == blocks - 1 else list(dict.fromkeys([*keep, "text"]))
        docs = _match_block(docs, carried, block, n > 0)
    return docs


def contaminated() -> F.Column:
    hit, words = F.col("_op4.n_hit"), F.col("_op4.n_words")
    return (hit > 0) & (20 * hit >= words)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "_op4.n_words", "_op4.n_hit", F.size("_op4.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "_op4.items"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


# Words with their place; windows of 13 words or of a whole shorter item, per item; their occurrences.
ORACLE = r"""
WITH low AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, p.n, i FROM places p JOIN windows v ON p.n = v.n AND p.s = v.s),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low l LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
