"""Files as rows: CSV with types from its first row, texts, media, descriptors."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.sources.catalog import SPARK_TYPES
from sparkloom.sql.ast import Column


def literal_type(text: str | None) -> str:
    """INT, then FLOAT, then VARCHAR."""
    for kind, make in (("INT", int), ("FLOAT", float)):
        try:
            make((text or "").strip())
            return kind
        except ValueError:
            pass
    return "VARCHAR"


def csv_columns(spark: SparkSession, path: str, key: str | None = None, index: str | None = None) -> list[Column]:
    """Columns from the header and the first row only, so no scan of the file; the key is the named or the first column."""
    head = [r.value for r in spark.read.text(path).limit(2).collect()]
    if not head:
        raise ValueError(f"{path} has no header")
    rows = list(islice(csv.reader(head), 2))
    names, first = rows[0], rows[1] if len(rows) > 1 else []
    key = key or names[0]
    if key not in names:
        raise ValueError(f"no column '{key}' in {path}")
    kinds = [literal_type(first[i]) if i < len(first) else "VARCHAR" for i in range(len(names))]
    return [Column(n, k, 100 if k == "VARCHAR" else None, n == key, index if n == key else None) for n, k in zip(names, kinds, strict=True)]


def read_csv(spark: SparkSession, path: str, columns: list[Column], blanks_as_zero: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows as text): one pass of a schema-bound read, values cast without raising."""
    raw = spark.read.schema(T.StructType([T.StructField(c.name, T.StringType()) for c in columns])).csv(path, header=True)
    out, bad = [], F.lit(False)
    for c in columns:
        text = F.trim(F.col(f"`{c.name}`"))
        if c.type in ("INT", "FLOAT"):
            text = F.when(text.isNull() | (text == ""), F.lit("0") if blanks_as_zero else F.lit(None)).otherwise(text)
            value = text.try_cast(SPARK_TYPES[c.type])
            bad = bad | (text.isNotNull() & value.isNull())
            out.append(F.nanvl(value, F.lit(None).cast("double")).alias(c.name) if c.type == "FLOAT" else value.alias(c.name))
        else:
            out.append(F.col(f"`{c.name}`").alias(c.name))
    return raw.where(~bad).select(*out), raw.where(bad)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, name, text) of .txt and .text files, ids from 1 in the order of names."""
    rows = spark.read.text(path, wholetext=True).withColumn("name", F.col("_metadata.file_path"))
    rows = rows.where(F.lower("name").rlike(r"\.(txt|text)$")).select("name", F.col("value").alias("text"))
    from sparkloom.sources.catalog import with_positions

    return with_positions(rows.sort("name"), 1).select(F.col("_pos").alias("doc_id"), "name", "text")


def read_media(spark: SparkSession, path: str, endings: tuple[str, ...], first_id: int = 1) -> DataFrame:
    """(item_id, name, content) of files with one of these endings."""
    rows = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike("\\.(" + "|".join(endings) + ")$"))
    from sparkloom.sources.catalog import with_positions

    return with_positions(rows.select(F.col("path").alias("name"), "content").sort("name"), first_id).select(F.col("_pos").alias("item_id"), "name", "content")


def extract(media: DataFrame, extractor: Callable[[bytes], list[list[float]]]) -> DataFrame:
    """(item_id, desc_no, descriptor) by any function from a file's bytes to its descriptors; items without one have no rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, n, [float(x) for x in d]) for i, content in zip(part["item_id"], part["content"], strict=True) for n, d in enumerate(extractor(content))]
            yield pd.DataFrame(rows, columns=["item_id", "desc_no", "descriptor"])

    return media.mapInPandas(run, "item_id long, desc_no long, descriptor array<double>")
