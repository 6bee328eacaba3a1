"""Access and write semantics of the storage structures over any DataFrame, for those who need no catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seq_insert(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The table after inserting rows in `order`, where a key that is there refuses the row."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def key_range(df: DataFrame, key: str, low, high) -> DataFrame:
    """Inclusive, in key order; nothing where low > high."""
    return df.where(F.col(key).between(low, high)).orderBy(key)


def isam_range(df: DataFrame, key: str, low, high) -> DataFrame:
    """As key_range, with bounds that may come in either order."""
    return df.where(F.col(key).between(min(low, high), max(low, high)))


def upsert(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace those of their keys."""
    return df.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def base_and_delta(base: DataFrame, delta: DataFrame) -> DataFrame:
    return base.unionByName(delta)


def delete(df: DataFrame, where) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def hash_directory(df: DataFrame, key: str, depth: int = 2) -> DataFrame:
    """Rows in each bucket by the low bits of the key's md5 (up to 4 bits)."""
    low = F.conv(F.right(F.md5(F.col(key).cast("string").cast("binary")), F.lit(1)), 16, 10).cast("int")
    return df.groupBy(low.bitwiseAND(F.lit((1 << depth) - 1)).alias("bucket")).agg(F.count("*").alias("n"))
