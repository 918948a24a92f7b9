"""Cross-site boilerplate lines by the spread of their sites (operator 7).

Every line gets a HyperLogLog sketch of the sites it occurs on, merged by aggregation. Lines whose
estimate is clearly at or above ``MIN_SITES`` are boilerplate; those near it are decided by an exact
distinct count. Boilerplate stays in the document of the smallest id that has it and is removed from
all others, so a passage that was copied to many sites is kept once.

DataFrame functions only. Lines are compared without white space at their ends; lines of white space
alone are never removed. A null site counts as none, a null text stays null, a row with null id has
no first claim on a line. Rows with equal id and text are one document and get equal results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motoquant.llm.store import row_key, settle, table
from motoquant.operators.joins import lookup_join, small_enough

MIN_SITES = 10
LG_K = 10
MARGIN = 5 * 1.04 / math.sqrt(1 << LG_K)  # standard errors within which a line is counted exactly
BLANK = " \t\n\x0b\x0c\r"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def lines_of(docs: DataFrame, site: str = "source") -> DataFrame:
    """One row per line with words: document, place, site and line hash."""
    rows = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(site).cast("string").alias("site"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    line = _trimmed(F.col("line"))
    return rows.filter(line != "").select("row", "doc_id", "site", "place", F.xxhash64(line).alias("line"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hash of every boilerplate line and the smallest id of a document that has it."""
    sited = lines.filter(F.col("site").isNotNull())
    sketches = sited.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("doc_id").alias("first"))
    spread = sketches.select("line", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = settle(spread.filter(F.col("sites") >= math.floor(min_sites * (1 - MARGIN))), "spread")
    near = F.col("sites") <= math.ceil(min_sites * (1 + MARGIN))
    unsure = spread.filter(near).select("line")
    exact = lookup_join(sited.select("line", "site"), unsure, "line", "inner").groupBy("line").agg(F.count_distinct("site").alias("n"))
    sure = exact.filter(F.col("n") >= min_sites).select("line")
    return spread.filter(~near).select("line", "first").unionByName(spread.join(sure, "line").select("line", "first"))


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with ``_kept`` (text without boilerplate) and ``_removed``, the number of removed lines.

    Columns of these names give way, those of ``_row`` and ``_dropped`` are left out; what must stay is
    carried inside a struct.
    """
    docs = docs.drop("_kept", "_removed", "_row", "_dropped")
    lines = lines_of(docs, site)
    known = settle(boilerplate(lines, min_sites), "boilerplate")
    hits = lookup_join(lines.select("row", "doc_id", "place", "line"), known, "line", "inner", checked=small_enough(known))
    hits = hits.filter(F.col("doc_id").isNull() | F.col("first").isNull() | (F.col("doc_id") > F.col("first")))
    dropped = hits.groupBy("row").agg(F.collect_set("place").alias("_dropped"))
    rows = docs.withColumn("_row", row_key()).join(dropped.withColumnRenamed("row", "_row"), "_row", "left")
    parts = F.split("text", "\n")
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_dropped")), lambda i: F.get(parts, i))
    kept = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    removed = F.coalesce(F.size("_dropped"), F.lit(0)).cast("long")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], kept.alias("_kept"), F.when(F.col("_dropped").isNull(), F.lit(0)).otherwise(removed).cast("long").alias("_removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select(
        "doc_id", F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: _trimmed(x) != "")), F.lit(0)).cast("long").alias("n_lines"),
        F.col("_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"),
    )


ORACLE = rf"""
WITH lines AS (
    SELECT doc_id, source, i, list_extract(l, i) AS line, trim(list_extract(l, i), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
    FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))),
known AS (SELECT t, min(doc_id) AS first FROM lines WHERE t <> '' AND source IS NOT NULL GROUP BY t HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (SELECT l.*, coalesce(doc_id > first, false) AS gone FROM lines l LEFT JOIN known USING (t))
SELECT doc_id, CAST(count(*) FILTER (t <> '') AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
