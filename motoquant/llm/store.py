"""Tables between the steps of an operator, in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motoquant.config import Rules
from motoquant.sources.tables import shared_dir

#: For a table of ids with a flag or two: so many rows are broadcast, a join by shuffle would move the texts.
IDS = Rules(broadcast_max_rows=2_000_000)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back: the lineage ends here and lost executors cost no recomputation."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> Column:
    """Names a row by its contents; rows with equal id and text are one document."""
    return F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), F.col("text"), F.col("text").isNull())


def free_name(columns: list[str], wanted: str) -> str:
    """The wanted name, or it with underscores in front until no column (compared without case) has it."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def fold(docs: DataFrame, *own: str) -> DataFrame:
    """The ``own`` columns and ``carried``, a struct of every column but the text.

    An operator's columns cannot clash with those of its caller while these lie inside the struct.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select(*[F.col(c) for c in own], rest.alias("carried"))


def unfold(folded: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The caller's columns in their order, out of ``text`` and ``carried``; some of them changed."""
    plain = {c: F.col("text") if c == "text" else F.col("carried").getField(c) for c in columns} | changed
    return folded.select(*[plain[c].alias(c) for c in columns])
