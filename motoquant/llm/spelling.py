"""Spelling variant grouping by blocked Gram matrices of letter counts (operator 11).

Words are lower-cased runs of letters; the contract's hash deletes a letter from some of them. Words of
at least ``LEAST_LETTERS`` letters that occur ``LEAST_TIMES`` are compared: products of letter-count
blocks give all squared distances of a block (a replaced letter makes 2, an inserted one 1), pairs of at
most 2 in equal or adjacent lengths are verified letter by letter.

Only words that agree outside a segment share a block. Segments start as the two halves of a word, one
of which holds the edit, so no near pair is lost; a block of more than ``BLOCK_WORDS`` words has its
segment halved again, as often as needed. A segment of one letter bounds a block by the alphabet. A pair
belongs to the one segment that holds its first difference, so it is counted once. Blocks give back one
row per word with a near word in it, never pairs.

Null texts have no words, a null id counts as empty text in the hash, repeated rows count as often as
they occur. Ties of the form go to the smallest word in code-point order. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motoquant.llm.store import settle, table
from motoquant.llm.words import LOWER, chunks, split_words, text_buffer
from motoquant.operators.joins import lookup_join, small_enough

LEAST_LETTERS = 7
LEAST_TIMES = 2
FORM_TIMES = 10  # a form occurs this many times as often as its variant
DELETE_EVERY = 31
BLOCK_WORDS = 1024  # words of a block before its segment is halved
TILE = 512  # words of one Gram product
TILE_BYTES = 1 << 22  # and letters of the padded words in it
HELD_WORDS = 400_000  # distinct words a task counts before it hands them on

_LEAD = 0xC3  # UTF-8 lead byte of all letters U+00C0 to U+00FF and of nothing else
_LATIN = 256


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & np.uint32(1), (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


_CRC = _crc_table()


def crc_of_words(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray, loop: int = 64) -> np.ndarray:
    """Unsigned crc32 of each word, carried on from the crc32 ``begun`` of what stands before it."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, state = starts[order], begun[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = size[order]
    longer = int(np.searchsorted(-size, -loop, "left"))  # words of more letters go through zlib
    for k in range(int(size[longer]) if longer < len(size) else 0):
        n = int(np.searchsorted(-size, -k, "left"))
        part = state[longer:n]
        state[longer:n] = _CRC[(part ^ buffer[at[longer:n] + k]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(longer):
        state[i] = zlib.crc32(buffer[at[i] : at[i] + size[i]], int(begun[order[i]]))
    out = np.empty(len(starts), np.uint32)
    out[order] = state
    return out


def words_with_slips(ids: list[str], texts) -> pa.Array:
    """Every word of at least ``LEAST_LETTERS`` letters of the texts, with the hashed letter deleted."""
    buffer, offsets = text_buffer(texts, LOWER)
    lead = buffer == _LEAD
    letter = (buffer >= 0x61) & (buffer <= 0x7A) | lead
    letter[1:] |= lead[:-1]
    words = split_words(letter.view(np.uint8), offsets, np.arange(256) == 1)
    leads = np.concatenate(([0], np.cumsum(lead)))
    starts, ends, text = words.starts, words.ends, words.text
    wide = leads[ends] - leads[starts]
    letters = ends - starts - wide
    enough = letters >= LEAST_LETTERS
    starts, ends, text, wide, letters = (a[enough] for a in (starts, ends, text, wide, letters))
    begun = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = crc_of_words(buffer, starts, ends, begun[text]) if len(starts) else np.zeros(0, np.uint32)
    slip = h % DELETE_EVERY == 0
    keep = ~slip | (letters > LEAST_LETTERS)
    starts, ends, wide, letters, h, slip = (a[keep] for a in (starts, ends, wide, letters, h, slip))
    gone = starts[slip] + h[slip] % letters[slip].astype(np.uint32)
    for k in np.flatnonzero(wide[slip]):
        s, e = starts[slip][k], ends[slip][k]
        heads = np.flatnonzero(buffer[s:e] & 0xC0 != 0x80)
        gone[k] = s + heads[gone[k] - s]
    two = lead[gone]
    edge = np.zeros(len(buffer) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    held = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    held[gone] = False
    held[gone[two] + 1] = False
    size = ends - starts
    size[slip] -= 1 + two
    place = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(place), pa.py_buffer(buffer[held]))


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` and its occurrences ``n``, of words to compare. Counts merge in the task and before the shuffle."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for piece in chunks(batches):
            found = pc.value_counts(words_with_slips(piece.column("id").to_pylist(), piece.column("text")))
            held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            size += len(found)
            if size > HELD_WORDS:
                held = [merged()]
                size = held[0].num_rows
                if size > HELD_WORDS // 2:
                    yield from held[0].cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(1 << 16)
                    held, size = [], 0
        if held:
            yield from merged().cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(1 << 16)

    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= LEAST_TIMES)


# --- near words --------------------------------------------------------------------------------


def in_halves(words: DataFrame) -> DataFrame:
    """Each word in the blocks of its own length and of the next shorter one, for both halves of the shorter."""
    letters = F.length("word")
    both = words.select("word", "n", F.explode(F.array(letters, letters - 1)).alias("size")).filter(F.col("size") >= LEAST_LETTERS)
    return both.select("word", "n", "size", F.inline(_halves(F.lit(0), F.col("size"))))


def _halves(low: Column, high: Column) -> Column:
    middle = F.floor((low + high) / 2).cast("int")
    return F.array(F.struct(low.alias("low"), middle.alias("high")), F.struct(middle.alias("low"), high.alias("high")))


def _block_key() -> Column:
    """Names what the words of a block share: the shorter length, the segment, and all letters outside it.

    Two blocks of one name do no harm: pairs are verified and must have one segment.
    """
    tail = F.col("size") - F.col("high")
    return F.xxhash64("size", "low", "high", F.substring("word", F.lit(1), F.col("low")), F.when(tail > 0, F.expr("right(word, size - high)")).otherwise(""))


def _latin(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the words as one byte each, and where each word begins."""
    raw, offsets = text_buffer(words)
    lead = raw == _LEAD
    after = np.zeros(len(raw), bool)
    after[1:] = lead[:-1]
    letters = np.where(after, raw + np.uint8(0x40), raw)[~lead]
    place = np.concatenate(([0], np.cumsum(~lead)))
    return letters, place[offsets]


def _tiles(letters: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter counts of the words, and the words padded with one empty column more than the longest."""
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(letters)) - np.repeat(first[:-1] - first[0], size)
    counts = np.bincount(row * _LATIN + letters, minlength=len(size) * _LATIN).reshape(len(size), _LATIN)
    padded = np.zeros((len(size), int(size.max()) + 1), np.uint8)
    padded[row, place] = letters
    return counts[:, counts.any(axis=0)].astype(np.float32) if len(size) else counts, padded


def first_difference(a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Place of the one edit from each padded row of ``a`` to that of ``b``, -1 if there isn't exactly one.

    ``longer`` marks pairs in which b has one letter more; the others have equal lengths.
    """
    differs = a != b
    place = differs.argmax(axis=1)
    moved = np.zeros_like(differs)
    moved[:, :-1] = a[:, :-1] != b[:, 1:]
    moved &= np.arange(a.shape[1]) >= place[:, None]
    one = np.where(longer, ~moved.any(axis=1), differs.sum(axis=1) == 1)
    return np.where(one & differs.any(axis=1), place, -1)


def near_pairs(words: pa.Array, block: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of near words that share a block; blocks are consecutive rows. Gram products in tiles."""
    letters, first = _latin(words)
    length = np.diff(first)
    short = length == size
    out: list[tuple[np.ndarray, np.ndarray]] = []
    edges = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)])) if len(block) else np.zeros(1, np.int64)
    # whole blocks side by side up to a tile; a larger block is cut and its tiles meet each other
    at = 0
    while at < len(edges) - 1:
        to = at + 1
        width = int(length[edges[at] : edges[to]].max()) + 1
        while to < len(edges) - 1 and edges[to + 1] - edges[at] <= TILE:
            wider = max(width, int(length[edges[to] : edges[to + 1]].max()) + 1)
            if wider * (edges[to + 1] - edges[at]) > TILE_BYTES:
                break
            to, width = to + 1, wider
        step = max(1, min(TILE, TILE_BYTES // width))
        begin, end = int(edges[at]), int(edges[to])
        cuts = list(range(begin, end, step)) + [end]
        for x in range(len(cuts) - 1):
            for y in range(x, len(cuts) - 1):
                out.append(_meet(letters, first, short, block, low, high, size, slice(cuts[x], cuts[x + 1]), slice(cuts[y], cuts[y + 1])))
        at = to
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _meet(letters, first, short, block, low, high, size, x: slice, y: slice) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of two tiles (or of one with itself), the shorter word first."""
    rows = np.r_[x, y] if x != y else np.r_[x]
    counts, padded = _tiles(np.concatenate([letters[first[s.start] : first[s.stop]] for s in ((x, y) if x != y else (x,))]), np.concatenate(([0], np.cumsum(np.diff(first)[rows]))))
    n = x.stop - x.start
    left, right = (counts[:n], counts[n:]) if x != y else (counts, counts)
    norm = (counts * counts).sum(axis=1)
    distance = norm[:n, None] + (norm[n:] if x != y else norm)[None, :] - 2 * (left @ right.T)
    close = (distance <= 2) & (distance > 0) & (block[x][:, None] == block[y][None, :])
    i, j = np.nonzero(np.triu(close, 1) if x == y else close)
    d = distance[i, j]
    i, j = i, j + (n if x != y else 0)
    swap = ~short[rows[i]]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    longer = ~short[rows[j]]
    a, b = rows[i], rows[j]
    fits = short[a] & (d == np.where(longer, 1, 2)) & (size[a] == size[b]) & (low[a] == low[b]) & (high[a] == high[b])
    i, j, longer = i[fits], j[fits], longer[fits]
    kept = []
    step = max(1, TILE_BYTES // padded.shape[1])
    for k in range(0, len(i), step):
        place = first_difference(padded[i[k : k + step]], padded[j[k : k + step]], longer[k : k + step])
        a = rows[i[k : k + step]]
        kept.append((place >= low[a]) & ((place < high[a]) | (high[a] == size[a])))
    own = np.concatenate(kept) if kept else np.zeros(0, bool)
    return rows[i[own]], rows[j[own]]


def _neighbours(table: pa.Table) -> pa.RecordBatch:
    """Per word of the blocks that has near words: how many, and the commonest, the smallest of equals."""
    words, n = table.column("word").combine_chunks(), table.column("n").to_numpy()
    a, b = near_pairs(words, *(table.column(c).to_numpy() for c in ("key", "size", "low", "high")))
    own, other = np.concatenate((a, b)), np.concatenate((b, a))
    rank = np.empty(len(words), np.int64)
    rank[pc.array_sort_indices(words).to_numpy()] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], own))
    own, other = own[order], other[order]
    head = np.flatnonzero(np.diff(own, prepend=-1))
    near = np.diff(np.append(head, len(own)))
    best = pa.array(other[head])
    return pa.RecordBatch.from_arrays([words.take(pa.array(own[head])), pa.array(near, pa.int64()), pa.array(n[other[head]], pa.int64()), words.take(best)], ["word", "near", "best_n", "best"])


def compare_blocks(blocks: DataFrame) -> DataFrame:
    """One row per word and block in which it has near words. Blocks arrive whole, one after another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole_blocks(table: pa.Table) -> pa.RecordBatch:
            key = table.column("key").to_numpy()
            edge = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
            several = np.repeat(np.diff(edge) > 1, np.diff(edge))
            return _neighbours(table.filter(pa.array(several)))

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            key = table.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
            if last:
                yield whole_blocks(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None and rest.num_rows:
            yield whole_blocks(rest)

    dealt = blocks.select("key", "word", "n", "size", "low", "high").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "word string, near long, best_n long, best string")


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every word with its number of near words and the commonest of them."""
    level, parts = in_halves(words), []
    while True:
        keyed = level.withColumn("key", _block_key())
        counts = keyed.filter("high - low > 1").groupBy("key").agg(F.count(F.lit(1)).alias("words"))
        large = settle(counts.filter(F.col("words") > block_words).select("key"), "large-blocks")
        if large.isEmpty():
            parts.append(compare_blocks(keyed))
            break
        fits = small_enough(large)
        parts.append(compare_blocks(lookup_join(keyed, large, "key", "left_anti", checked=True) if fits else keyed.join(large, "key", "left_anti")))
        split = lookup_join(keyed, large, "key", "left_semi", checked=True) if fits else keyed.join(large, "key", "left_semi")
        level = settle(split.select("word", "n", "size", F.inline(_halves(F.col("low"), F.col("high")))), "split-blocks")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))
    rows = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<less: long, word: string>").alias("best"))
    rows = rows.unionByName(found.select("word", F.lit(None).cast("long").alias("n"), "near", best.alias("best")))
    merged = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return merged.select("word", "n", "n_near", F.col("best.word").alias("best"), (-F.col("best.less")).alias("best_n"))


def group_variants(words: DataFrame, times: int = FORM_TIMES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Form and root of every word. A form is ``times`` as common, so chains are short and end."""
    near = settle(near_words(words, block_words), "near-words")
    holds = F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False))
    rows = near.select("word", F.when(holds, F.col("best")).alias("form"), "n", "n_near", F.when(holds, F.col("best_n")).alias("form_n"))
    links = rows.filter("form is not null").select(F.col("word").alias("root"), F.col("form").alias("up"))
    done = rows.filter("form is null").withColumn("root", F.col("word"))
    open_ = rows.filter("form is not null").withColumn("root", F.col("form"))
    while True:
        stepped = settle(open_.join(links, "root", "left"), "variant-roots")
        done = done.unionByName(stepped.filter("up is null").drop("up"))
        open_ = stepped.filter("up is not null").withColumn("root", F.col("up")).drop("up")
        if open_.isEmpty():
            return done.select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(settle(count_words(table(spark, sf_dir, "documents")), "spelling-words"))
