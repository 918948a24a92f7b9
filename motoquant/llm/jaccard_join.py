"""N-gram Jaccard join by parity sketches (operator 2).

A document is its set of distinct word shingles; equal sets are one node from the start. Two sets of
sizes a and b are linked if their similarity is at least t, so they differ in at most
d = (a + b)(1 - t)/(1 + t) shingles. Shingles are dealt into d + e parts by a hash and each part is the
XOR of its shingle hashes. A differing shingle changes one part, so linked sets share at least e parts,
and one of the d + 1 densest parts of each. Band by band of set sizes, these parts are joined.

A joined part only proposes candidates. Every member of a part is compared with its head, the member
that shares most parts with others. Members that this leaves in different components are compared with
each other in blocks of bounded size. Comparison is by a parity sketch of 1024 bits first, whose Hamming
distance never exceeds the number of differing shingles, and exactly by the shingle sets after; blocks
give out only pairs that their sketches allow. So every link is found or its ends are connected.

Null texts and texts without words have no shingles and no links. Rows with equal id and text are one
document; equal ids with different texts are linked only by their texts. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motoquant.llm.components import components
from motoquant.llm.store import row_key, settle, table
from motoquant.llm.words import LOWER, NOT_SPACE, annotate, lists, mix, window_hashes, words_of
from motoquant.operators.joins import lookup_join

SKETCH_BITS = 1024
BAND_RATIO = 1.3
KNOWN_SETS = 1_000_000  # sets a task remembers, so that copies within it propose nothing again
BROADCAST_ROWS = 2_000_000  # longs
BLOCK_MEMBERS = 2048  # members of a part in a block; two blocks meet in a task
BATCH_MEMBERS = 8192
TILE = 64


@dataclass(frozen=True)
class Band:
    """Sets of sizes low to high, those being the smaller of a pair, with partners up to ``partner``."""

    low: int
    high: int
    partner: int
    differ: int
    parts: int


@dataclass(frozen=True)
class Similarity:
    """At least num/den, over shingles of ``words`` words."""

    words: int = 4
    num: int = 85
    den: int = 100

    def partner(self, size: int) -> int:
        return size * self.den // self.num

    def differ(self, a, b):
        """Most shingles in which linked sets of these sizes differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def bands(self, largest: int) -> list[Band]:
        """From the least size at which different sets can be linked."""
        low = 1
        while not self.differ(low, self.partner(low)) and low <= largest:
            low += 1
        out = []
        while low <= largest:
            high = max(low, int(low * BAND_RATIO))
            differ = self.differ(high, self.partner(high))
            out.append(Band(low, high, self.partner(high), differ, differ + 2 + differ // 8))
            low = high + 1
        return out

    def linked(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * common >= self.num * (a + b - common)


def shingles(column, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, and where each text's begin."""
    words = words_of(column, NOT_SPACE, LOWER)
    hashes, counts, text = words.hashes(), words.counts, words.text
    at = words.windows(words_each)
    short = words.first[:-1][(counts > 0) & (counts < words_each)]
    at = np.sort(np.concatenate((at, short)))
    text = text[at]
    found = window_hashes(hashes, at, np.minimum(counts[text], words_each))
    new = ~pd.Series(found ^ mix(text.astype(np.uint64) + np.uint64(1))).duplicated().to_numpy()
    return found[new], np.concatenate(([0], np.cumsum(np.bincount(text[new], minlength=len(counts)))))


def _totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return np.diff(total[first].astype(np.uint64))


def set_names(found: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each set, whatever the order of its members."""
    return mix(_totals(mix(found ^ np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64))), first) + np.diff(first).astype(np.uint64)).view(np.int64)


def sketches(found: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Parity of the number of shingles at each of the bits."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    bit = (mix(found ^ np.uint64(0xA24BAED4963EE407)) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    parity = np.bincount(owner * SKETCH_BITS + bit, minlength=n * SKETCH_BITS).astype(np.uint8) & 1
    return [row.tobytes() for row in np.packbits(parity.reshape(n, SKETCH_BITS), axis=1)] if n else []


def part_keys(found: np.ndarray, first: np.ndarray, similarity: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Key of every part that a set is joined by, and the set."""
    sizes = np.diff(first)
    keys, owners = [], []
    spread = mix(found ^ np.uint64(0xC3A5C85C97CB3127))
    for number, band in enumerate(similarity.bands(int(sizes.max(initial=0)))):
        rows = np.flatnonzero((sizes >= band.low) & (sizes <= band.partner))
        if not len(rows):
            continue
        of = np.repeat(np.arange(len(rows)), sizes[rows])
        at = np.repeat(first[rows] - np.concatenate(([0], np.cumsum(sizes[rows])[:-1])), sizes[rows]) + np.arange(len(of))
        part = ((spread[at] >> np.uint64(32)) % np.uint64(band.parts)).astype(np.int64) + of * band.parts
        content = np.zeros(len(rows) * band.parts, np.uint64)
        np.bitwise_xor.at(content, part, found[at])
        count = np.bincount(part, minlength=len(content))
        # densest first; equal parts have equal counts, so all sets order them alike
        order = np.lexsort((content, -count, np.repeat(np.arange(len(rows)), band.parts))).reshape(len(rows), band.parts)
        chosen = order[:, : band.differ + 1].ravel()
        keys.append(mix(content[chosen] ^ mix((chosen % band.parts + (number + 1 << 32)).astype(np.uint64))))
        owners.append(np.repeat(rows, band.differ + 1))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


PROFILE = "n_shingles long, set long, proof long, sketch binary"


def profiles(docs: DataFrame, similarity: Similarity) -> DataFrame:
    """Row key, id, size, two names of the set and its sketch; sets without members have null names."""
    def start():
        def step(piece: pa.RecordBatch) -> list:
            found, first = shingles(piece.column("text"), similarity.words)
            none = np.diff(first) == 0
            return [np.diff(first), pa.array(set_names(found, first, 0), mask=none), pa.array(set_names(found, first, 1), mask=none), sketches(found, first)]
        return step
    rows = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return annotate(rows, ["row", "doc_id"], PROFILE, start)


def proposals(docs: DataFrame, similarity: Similarity) -> DataFrame:
    """``key`` and ``set`` of every part of every set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from motoquant.llm.words import chunks

        known: set[int] = set()
        for piece in chunks(batches):
            found, first = shingles(piece.column("text"), similarity.words)
            names = set_names(found, first, 0)
            keys, owner = part_keys(found, first, similarity)
            new = ~pd.Series(names).duplicated().to_numpy() & np.fromiter((x not in known for x in names.tolist()), bool, len(names))
            if len(known) > KNOWN_SETS:
                known.clear()
            known.update(names[new].tolist())
            use = new[owner]
            yield pa.RecordBatch.from_arrays([pa.array(keys[use].view(np.int64)), pa.array(names[owner[use]])], ["key", "set"])
    return docs.select("text").mapInArrow(run, "key long, set long")


def _near(pairs: DataFrame, sets: DataFrame, similarity: Similarity) -> DataFrame:
    """Pairs whose sizes and sketches allow a link."""
    one = lambda x: sets.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(x).to_numpy() for x in ("na", "nb"))
            both = [np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64) for x in ("sa", "sb")]
            apart = np.bitwise_count(both[0] ^ both[1]).sum(axis=1)
            near = (similarity.num * np.maximum(a, b) <= similarity.den * np.minimum(a, b)) & (apart <= similarity.differ(a, b))
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.join(one("a"), "a").join(one("b"), "b").mapInArrow(run, "a long, b long")


def _across(headed: DataFrame, sets: DataFrame, similarity: Similarity) -> DataFrame:
    """Pairs that share a part, lie in different components and are near by size and sketch.

    A part of many members is cut into blocks, and every two blocks meet in a group of their own.
    """
    members = headed.select("key", "set", "n", (F.col("set") == F.col("head")).alias("is_head"), F.coalesce("component", "set").alias("component"))
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    members = members.filter("not is_head").join(mixed, "key").join(sets.select("set", F.col("n").alias("size"), "sketch"), "set")
    blocks = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.withColumn("other", other).select(
        "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "set", "component", "size", "sketch",
    )

    def compare(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of near pairs of one group."""
        component, size, block = (group.column(c).to_numpy() for c in ("component", "size", "block"))
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)
        low, high = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        mine, theirs = np.flatnonzero(block == low), np.flatnonzero(block == high)
        found = []
        for at in range(0, len(mine), TILE):
            rows = mine[at : at + TILE]
            a, b = np.meshgrid(rows, theirs, indexing="ij")
            may = (component[a] != component[b]) & ((low != high) | (a < b))
            may &= similarity.num * np.maximum(size[a], size[b]) <= similarity.den * np.minimum(size[a], size[b])
            a, b = a[may], b[may]
            apart = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1)
            near = apart <= similarity.differ(size[a], size[b])
            found.append((a[near], b[near]))
        return tuple(np.concatenate(side) for side in zip(*found)) if found else (mine[:0], mine[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            names = [rows.column(c).to_numpy() for c in ("key", "x", "y")]
            edges = np.flatnonzero(np.concatenate(([True], np.any([n[1:] != n[:-1] for n in names], axis=0))))
            ends = np.append(edges[1:], rows.num_rows)
            held[:] = [] if last else rows.slice(edges[-1]).to_batches()
            name, near = rows.column("set").to_numpy(), []
            for start, end in zip(edges, ends) if last else zip(edges[:-1], ends[:-1]):
                a, b = compare(rows.slice(start, end - start))
                near.append((name[start:end][a], name[start:end][b]))
            if near:
                a, b = (np.concatenate(side) for side in zip(*near))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH_MEMBERS:
                yield from whole(False)
        if held:
            yield from whole(True)

    return dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "a long, b long")


def _members(docs: DataFrame, wanted: DataFrame, similarity: Similarity) -> DataFrame:
    """Shingles, in order, of one document of every wanted set. ``wanted``: row and set."""
    rows = docs.select(row_key().alias("row"), "text")
    fits = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(wanted) if fits else wanted, "row")

    def start():
        def step(piece: pa.RecordBatch) -> list:
            found, first = shingles(piece.column("text"), similarity.words)
            order = np.lexsort((found, np.repeat(np.arange(len(first) - 1), np.diff(first))))
            return [lists(found[order].view(np.int64), np.diff(first), pa.int64())]
        return step

    return annotate(rows, ["set"], "members array<long>", start).dropDuplicates(["set"])


def _verify(pairs: DataFrame, members: DataFrame, similarity: Similarity) -> DataFrame:
    """Pairs that are linked."""
    one = lambda x: members.select(F.col("set").alias(x), F.col("members").alias(f"m{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for x in ("ma", "mb"):
                column = batch.column(x)
                sides.append((column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))))
            (a, fa), (b, fb) = sides
            common = np.array([len(np.intersect1d(a[fa[i] : fa[i + 1]], b[fb[i] : fb[i + 1]], assume_unique=True)) for i in range(batch.num_rows)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(similarity.linked(common, np.diff(fa), np.diff(fb))))

    return pairs.join(one("b"), "b").join(one("a"), "a").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: Similarity = Similarity()) -> DataFrame:
    """``row``, doc_id, n_shingles, component_id and ``group`` of every document.

    ``group`` names the documents that links connect, those of null id too; it is null for documents
    without shingles, which are linked with nothing.
    """
    known = settle(profiles(docs, similarity), "profiles")
    sets = known.filter(F.col("set").isNotNull()).groupBy("set").agg(
        F.any_value("n_shingles").alias("n"), F.any_value("sketch").alias("sketch"), F.min("row").alias("row"), F.min("doc_id").alias("least"),
        (F.min("proof") != F.max("proof")).alias("clash"),
    )
    sets = settle(sets, "sets")
    if sets.filter("clash").limit(1).count():
        raise RuntimeError("two different shingle sets got one 64-bit name")

    bounds = [F.expr(f"{f}(set) over (partition by key)") for f in ("min", "max", "count")]
    shared = proposals(docs, similarity).select("key", "set", *[c.alias(n) for c, n in zip(bounds, ("lo", "hi", "n"))])
    shared = settle(shared.filter("lo < hi").select("key", "set", "n"), "parts")
    company = shared.groupBy("set").agg(F.sum("n").alias("company"))
    heads = shared.join(company, "set").groupBy("key").agg(F.max(F.struct("company", "set"))["set"].alias("head"))
    headed = settle(shared.join(heads, "key"), "headed")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        near = settle(_near(pairs, sets, similarity), f"near-{name}")
        ends = near.select(F.col("a").alias("set")).unionByName(near.select(F.col("b").alias("set"))).distinct()
        wanted = settle(sets.select("set", "row").join(ends, "set"), f"wanted-{name}")
        return settle(_verify(near, settle(_members(docs, wanted, similarity), f"members-{name}"), similarity), f"links-{name}")

    star = headed.filter("set <> head").select(F.least("head", "set").alias("a"), F.greatest("head", "set").alias("b"))
    first = confirmed(star.distinct(), "heads")
    group = components(first).withColumnRenamed("node", "set")
    across = _across(headed.filter("n > 2").join(group, "set", "left"), sets, similarity)
    second = confirmed(across.distinct(), "across")
    group = components(first.unionByName(second)).withColumnRenamed("node", "set")

    named = sets.select("set", "least").join(group, "set", "left").select("set", "least", F.coalesce("component", "set").alias("component"))
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = settle(lookup_join(named, heads, "component").select("set", "component_id", F.col("component").alias("group")), "classes")
    found = lookup_join(known.select("row", "doc_id", "n_shingles", "set"), named, "set")
    component = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("row", "doc_id", "n_shingles", component.alias("component_id"), "group")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row", "group")
