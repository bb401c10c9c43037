"""Content hashes against a registered list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_contents(spark: SparkSession, path: str) -> DataFrame:
    """(source, content) of whole files; each file is one row, hashed where it is read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), "content")


def verify_manifest(contents: DataFrame, registered: DataFrame, key: str = "source") -> DataFrame:
    """``ok``, ``mismatch``, ``missing`` (registered only) or ``unregistered`` per source.

    The content is reduced to its hash before the join, so only keys and hashes move.
    """
    actual = contents.select(key, F.sha2("content", 256).alias("actual"))
    return actual.join(registered.select(key, F.col("sha256").alias("registered")), key, "full_outer").select(
        key, "actual", "registered",
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("registered").isNull(), "unregistered")
        .when(F.lower("registered") == F.col("actual"), "ok")
        .otherwise("mismatch")
        .alias("status"),
    )
