"""Session builder for tests and the bench; on a cluster the caller passes its own session."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def own_folder(spark: SparkSession) -> SparkSession:
    """On one machine, name a temporary folder for intermediate tables if the session names none.

    A cluster must name a folder that all its machines share.
    """
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.split("[")[0] == "local":
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="motoquant-"))
    return spark


def local_session(cores: int = 8, name: str = "motoquant") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return own_folder(spark)
