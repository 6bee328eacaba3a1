"""Helpers the training-data operators share: words, scratch tables, running totals."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed value: the characters between words.
SPACE = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression for a run of words' characters.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8; bytes.split() cuts at exactly the six characters of SPACE."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def n_words(column) -> F.Column:
    """Number of words of a text column inside the JVM; null has none."""
    spaced = F.trim(F.translate(F.coalesce(column, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    # With runs of spaces squeezed, words are one more than the spaces left.
    squeezed = F.regexp_replace(spaced, " {2,}", " ")
    return F.when(squeezed == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("long")


def give_back_memory() -> None:
    """Returns freed memory of a Python worker to the system, where the allocators can; they would keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidily(parts: Iterator) -> Iterator:
    """The batches of a task, with freed memory given back after each, so that a worker that Spark keeps stays small."""
    for part in parts:
        yield part
        del part
        give_back_memory()


def over_texts(docs: DataFrame, run: Callable[[], Callable[[list, list], Iterator[dict]]], shape: T.StructType, tidy: bool = False) -> DataFrame:
    """Maps (doc_id, text) by Arrow batches: run() is called once a task and gives a function from a batch's ids and texts
    to dicts of columns. Ids stay exact beside nulls, which pandas would turn to doubles. `tidy`: as in tidily()."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(shape)
        each = run()
        for batch in batches:
            for found in each(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], type=f.type) for f in out], schema=out)
            if tidy:
                del batch, found
                give_back_memory()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(mapped, shape)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a local one, but only in a session without a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


#: Narrow rows (a few longs) that a file of a scratch table holds, where the caller knows a bound on their number.
ROWS_A_FILE = 50_000


def stored(df: DataFrame, what: str = "table", at_most: int | None = None) -> DataFrame:
    """Cuts lineage: writes the rows as a table in the shared folder and reads them back.

    `at_most`: a bound on the number of rows, which are narrow; a small table then has few files even where its last
    shuffle has many partitions, for each file costs a task, a listing and an opening at every later read.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, what)
    if at_most is not None:
        df = df.coalesce(at_most // ROWS_A_FILE + 2)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table by the file system that holds it."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds `name`, the sum of `value` over all rows before this one by `order` (the first column is a long; null first).

    Rows are dealt over ranges of the first column, cut at approximate quantiles, one for about a million rows (256 to
    4096); a range's sum is one number on the driver, and a window only ever orders one range. Any cuts give the same
    totals. Takes a stored table: it is read three times.
    """
    first = order[0]
    parts = int(min(4096, max(256, df.count() // 1_000_000)))
    cuts = df.agg(F.percentile_approx(first, [i / parts for i in range(1, parts)], 10 * parts)).head()[0]
    cuts = np.array(sorted(set(cuts or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(dtype="int64"), "right").astype("int32") + 1)

    ranges = F.when(F.col(first).isNull(), F.lit(0)).otherwise(range_of(F.coalesce(F.col(first), F.lit(0).cast("long"))))
    dealt = df.withColumn("_range", ranges)
    sums = dict(sorted((r[0], r[1] or 0) for r in dealt.groupBy("_range").agg(F.sum(value)).collect()))
    before, total = {}, 0
    for k, v in sums.items():
        before[k], total = total, total + v
    offsets = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    rows = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(rows), F.lit(0))
    return dealt.withColumn(name, (inside + F.element_at(offsets, F.col("_range"))).cast("long")).drop("_range")


def crc32_mod(column, m: int):
    """crc32 of the id as text, modulo m."""
    return F.crc32(column.cast("string").cast("binary")) % m


def sampled(rows: DataFrame, most: int, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """At most `most` rows of fold(rows), which has a row for each doc_id, by the order of a hash of doc_id.

    Only rows whose hash is under a bound are folded and sorted: the bound lets through about four times as many ids as
    are asked for, by an estimate of their number, and rises where those prove too few. So few rows move at any size of
    the input, and the result is the same whatever the bound.
    """
    key = F.xxhash64("doc_id").cast("double")
    share = min(1.0, 4.0 * most / max(rows.agg(F.approx_count_distinct("doc_id")).head()[0], 1))
    while True:
        found = fold(rows if share == 1 else rows.where(key < (share - 0.5) * 2.0**64))
        if share == 1 or found.limit(most).count() == most:
            return found.orderBy(key, "doc_id").limit(most)
        share = min(1.0, 4 * share)


def sampled_labels(labels: DataFrame, column: str, most: int) -> DataFrame:
    """At most `most` labelled ids, by the order of a hash of the id; an id labelled twice counts with its larger label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return sampled(known, most, lambda rows: rows.groupBy("doc_id").agg(F.max(column).cast("int").alias("label")))


LONG, INT, STRING, DOUBLE, BINARY = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BinaryType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
