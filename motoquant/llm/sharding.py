"""Sharding by a hierarchical weighted hash tree (operator 8, law ``key``).

A row descends from region to rack to shard. At each node every child draws an exponential value of
its weight from a hash of row id and child, and the smallest draw wins, so a child takes its share of
the weight. Raising one child's weight moves rows only into it; subtrees whose weights stay keep all
their rows. A new shard is added as a branch of its own, so rows move into it and nowhere else.

Only id and shard count decide; equal ids share a shard. A null id is an id of its own. A null text
has size 16 and the digest of the empty text. Slots are numbered by deal, id and digest, repeated rows
side by side. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motoquant.llm.store import settle, table

Rack = list[float]  # weight of each shard
Tree = list[list[Rack]]  # regions of racks of shards

DEALS = 64  # parts of a shard that are numbered on their own
HEX_DIGITS = 13  # of a digest, 52 bits: exact in a double


def even_tree(regions: int = 4, racks: int = 5, shards: int = 2) -> Tree:
    return [[[1.0] * shards for _ in range(racks)] for _ in range(regions)]


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, which gets the next number."""
    return [*tree, [[weight]]]


def _number(*parts: Column | str) -> Column:
    text = F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("double")


def _draw(key: Column, level: str, path: Column, weights: Column) -> Column:
    """Index of the child with the smallest draw; children without weight never win."""
    def one(weight: Column, i: Column) -> Column:
        uniform = (_number(key, level, path, i) + 1) / F.lit(float(1 << 4 * HEX_DIGITS))
        return F.struct(F.when(weight > 0, -F.log(uniform) / weight).otherwise(F.lit(float("inf"))).alias("draw"), i.alias("child"))
    return F.array_min(F.transform(weights, one))["child"]


def assign(key: Column, tree: Tree) -> Column:
    """Shard of a row id. Shards are numbered in tree order."""
    rack_weight = [[sum(rack) for rack in region] for region in tree]
    numbers, n = [], 0
    for region in tree:
        numbers.append([])
        for rack in region:
            numbers[-1].append(list(range(n, n + len(rack))))
            n += len(rack)
    constant = lambda value, kind: F.from_json(F.lit(str(value)), kind)
    region = _draw(key, "region", F.lit(""), constant([sum(r) for r in rack_weight], "array<double>"))

    def in_region(r: Column) -> Column:
        rack = _draw(key, "rack", r, constant(rack_weight, "array<array<double>>")[r])
        return F.transform(F.array(rack), lambda k: _leaf(r, k))[0]

    def _leaf(r: Column, k: Column) -> Column:
        shard = _draw(key, "shard", F.concat_ws("/", r, k), constant(tree, "array<array<array<double>>>")[r][k])
        return F.transform(F.array(shard), lambda s: constant(numbers, "array<array<array<int>>>")[r][k][s])[0]

    # a draw is bound once by transform, so that deeper levels refer to its value
    return F.transform(F.array(region), in_region)[0]


def shard_rows(docs: DataFrame, tree: Tree, deals: int = DEALS) -> DataFrame:
    """Shard, place in it and shard after growth of every row.

    Slots come from counts of every (shard, deal), a table of fixed size, and a row number within
    each deal, so no shard passes through one task.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    ).select(
        "*", F.lit("key").alias("law"), assign(F.col("doc_id"), tree).alias("shard"), assign(F.col("doc_id"), grow(tree)).alias("grown_shard"),
        (_number(F.col("doc_id"), "deal", F.col("text_crc32")) % deals).cast("int").alias("deal"),
    )
    rows = settle(rows, "shards")
    before = W.partitionBy("shard").orderBy("deal").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "deal").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("shard", "deal").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("within", F.row_number().over(within) - 1).join(F.broadcast(offsets), ["shard", "deal"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("base") + F.col("within")).cast("long").alias("slot"), "grown_shard")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), even_tree())

