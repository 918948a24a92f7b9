"""From raw documents to packed sequences: five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, whatever stage made them.
All but the last return the columns they got, whatever their names: columns that a stage does not need
pass inside a struct. Every stage takes empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motoquant.llm import decontamination, jaccard_join, line_dedup, packing, quality
from motoquant.llm.store import fold, row_key, settle, table, unfold
from motoquant.operators.joins import lookup_join, small_enough

#: Near duplicates of the pipeline: five-word shingles, similarity of at least 0.8.
NEAR = jaccard_join.Similarity(words=5, num=80, den=100)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the likelihood ratio keep.

    Null and empty texts have no words and go. Repeated rows are judged alike; a row of null id has no
    label and is judged like any other.
    """
    labels = table(spark, sf_dir, "labels")
    rows = fold(docs, "doc_id", "text")
    counts = quality.count_grams(rows, labels)
    measured = settle(quality.measure(rows, counts, ["doc_id"]), "quality")
    threshold = quality.find_threshold(measured, labels)
    return unfold(quality.measure(rows, counts, ["text", "carried"]).filter(quality.kept(threshold)), docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without boilerplate lines; n_chars follows a changed text.

    A null text stays null. Rows of equal id and text are one document: none of them takes a line from
    another. A row of null id has no first claim on a line.
    """
    found = line_dedup.remove_boilerplate(fold(docs, "doc_id", "text", "source"))
    changed = {"text": F.col("_kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_removed") > 0, F.length("_kept").cast("long")).otherwise(F.col("carried.n_chars"))
    return unfold(found, docs.columns, **changed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates one row, that of the smallest id, null ids last.

    Rows of equal id and text are one document, of which one row stays. Documents without words are
    linked with nothing: each of another id or text stays.
    """
    rows = fold(docs, "text").withColumn("doc_id", F.col("carried.doc_id"))
    found = settle(jaccard_join.near_duplicates(rows, NEAR).select("row", "doc_id", "group"), "stage-groups")
    copies = found.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.min("group").alias("group"))
    group = F.struct(F.col("group").isNull().alias("alone"), F.coalesce("group", "row").alias("name"))
    named = settle(copies.select("row", "n", F.struct(F.col("doc_id").isNull().alias("later"), "doc_id", "row").alias("rank"), group.alias("group")), "stage-copies")
    first = named.groupBy("group").agg(F.min("rank")["row"].alias("row"))
    gone = settle(named.select("row").join(first, "row", "left_anti"), "stage-gone")
    keyed = rows.withColumn("row", row_key())
    kept = lookup_join(keyed, gone, "row", "left_anti", checked=True) if small_enough(gone) else keyed.join(gone, "row", "left_anti")
    # rows of equal id and text: only they are dealt anew
    several = settle(named.filter("n > 1").select("row").join(gone, "row", "left_anti"), "stage-repeated")
    if several.isEmpty():
        return unfold(kept, docs.columns)
    kept = settle(kept, "stage-kept")
    one = lookup_join(kept, several, "row", "left_semi", checked=True) if small_enough(several) else kept.join(several, "row", "left_semi")
    other = lookup_join(kept, several, "row", "left_anti", checked=True) if small_enough(several) else kept.join(several, "row", "left_anti")
    pick = F.struct(F.xxhash64("carried").alias("hash"), "text", "carried")
    one = one.groupBy("row").agg(F.min_by(F.struct("text", "carried"), pick["hash"]).alias("r")).select("r.text", "r.carried")
    return unfold(other.select("text", "carried").unionByName(one), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold too little of the benchmark to count as contaminated; texts without words stay."""
    found = decontamination.decontaminate(fold(docs, "text"), table(spark, sf_dir, "benchmark"), ["text", "carried"])
    return unfold(found.filter(~decontamination.contaminated()), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset. A null text is packed as an empty one; other columns are left out."""
    return packing.pack_documents(docs, packing.public_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The stages hash, mine and tokenise; SQL can't express them. A test rebuilds them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
