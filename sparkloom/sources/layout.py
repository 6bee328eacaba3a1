"""Index hints as physical layouts: they order, split or cluster files and never change an answer but for duplicate keys."""

from __future__ import annotations

from pyspark.sql import Column as Expression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.sql.ast import Column

ORDERED = ("SEQ", "BTREE", "ISAM")
UNIQUE = ("SEQ", "HASH", "RTREE", "BOW")
UPSERT = ("HASH", "RTREE", "BOW")
BUCKET, BUCKETS = "_bucket", 16
DESCRIPTIONS = {
    "SEQ": "key order, unique keys; ranges by file statistics", "BTREE": "key order, equal keys kept", "ISAM": "key order with later rows beside it, equal keys kept",
    "HASH": "files split by a hash of the key; the last row of a key wins", "RTREE": "clustered by place; the last row of a key wins", "BOW": "rows with a full-text index; the last row of a key wins", "HEAP": "order of insertion",
}


def choose(columns: list[Column]) -> str:
    """Any BOW column decides; then the key's own index; an array key or index makes RTREE; else BTREE."""
    if any(c.index == "BOW" for c in columns):
        return "BOW"
    key = next((c for c in columns if c.is_key), None)
    if key and key.index:
        return key.index
    return "RTREE" if any(c.type == "ARRAY[FLOAT]" for c in columns) else "BTREE"


def bucket(key: Expression) -> Expression:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def stored_schema(schema: T.StructType, table) -> T.StructType:
    out = T.StructType([*schema.fields, T.StructField("_pos", T.LongType())])
    return out.add(BUCKET, T.IntegerType()) if table.structure == "HASH" else out


def write(rows: DataFrame, table, path: str) -> None:
    """Ordered structures: ranges of the key, sorted within; Hash: a folder per bucket, so that point searches read one;
    RTree: ranges of the first coordinates, whose statistics then prune."""
    key = F.col(f"`{table.key}`")
    if table.structure in ORDERED:
        rows = rows.repartitionByRange(key).sortWithinPartitions(key, "_pos")
    elif table.structure == "HASH":
        rows.withColumn(BUCKET, bucket(key)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)
        return
    elif table.structure == "RTREE":
        place = next((c.name for c in table.columns if c.type == "ARRAY[FLOAT]"), None)
        if place:
            x = F.get(F.col(f"`{place}`"), 0)
            rows = rows.repartitionByRange(x).sortWithinPartitions(x)
    rows.write.parquet(path)


def to_value(column: Column, value):
    """A literal as the column stores it: VARCHAR cut at its size in UTF-8 bytes, whole characters only; a date as text."""
    if value is None:
        return None
    if column.type == "INT":
        return int(value)
    if column.type == "FLOAT":
        return float(value)
    if column.type == "ARRAY[FLOAT]":
        return [float(x) for x in value]
    text = str(value)
    size = column.size or (50 if column.type == "VARCHAR" else None)
    return text.encode()[:size].decode(errors="ignore") if size else text


def point_filter(table, value) -> Expression | None:
    """For Hash tables, the bucket in which a key's row must be."""
    column = next(c for c in table.columns if c.is_key)
    if table.structure != "HASH" or table.source is not None:
        return None
    kind = {"INT": "int", "FLOAT": "double"}.get(column.type, "string")
    return F.col(BUCKET) == bucket(F.lit(value).cast(kind))
