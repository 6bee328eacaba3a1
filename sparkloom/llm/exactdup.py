"""Exact duplicates by composable polynomial fingerprints.

A chunk's fingerprint is its bytes as a polynomial, modulo two primes; two neighbours combine as left * base ** length of
right + right. So the parts of a huge document are hashed by several tasks and their fingerprints combined. Rows whose
fingerprints and lengths are equal are candidates; the texts of a candidate group stream past one another and are
compared chunk by chunk, which alone says what is equal: a group that only a collision made falls apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkloom.llm import common
from sparkloom.llm.common import BINARY, LONG, SPACE, STRING

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_190_494_759, 731_871_143)
CHUNK = 4096
#: Code points beyond which a text's parts, of so many each, are hashed by tasks of their own.
HUGE = 1 << 20
_SPACE = SPACE.encode()


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * base % prime)
    return np.array(out[::-1], dtype=np.float64)


_POWERS = np.column_stack([_powers(b, p, CHUNK) for b, p in zip(BASES, PRIMES, strict=True)])

Print = tuple[int, int, int]


def combine(left: Print, right: Print) -> Print:
    """The fingerprint of two neighbours together: (hash, hash, length)."""
    a, b = (int((x * pow(base, right[2], p) + y) % p) for x, y, base, p in zip(left[:2], right[:2], BASES, PRIMES, strict=True))
    return a, b, left[2] + right[2]


def chunk_prints(data: bytes) -> np.ndarray:
    """Fingerprints of data's chunks of CHUNK bytes, all at once: byte + 1 by powers of the base; below 2**53, so exact in doubles."""
    n = -(-len(data) // CHUNK)
    pad = n * CHUNK - len(data)
    grid = np.zeros(n * CHUNK)
    grid[pad:] = np.frombuffer(data, dtype=np.uint8)  # the first chunk is the short one
    grid[pad:] += 1
    return np.column_stack([(grid.reshape(n, CHUNK) @ _POWERS[:, [k]])[:, 0] % PRIMES[k] for k in range(2)]).astype(np.int64)


def fingerprint(data: bytes) -> Print:
    """Of whole bytes, combined from chunks pairwise as in a tree."""
    if not data:
        return 0, 0, 0
    first = len(data) % CHUNK or CHUNK
    level = [(int(a), int(b), first if i == 0 else CHUNK) for i, (a, b) in enumerate(chunk_prints(data))]
    while len(level) > 1:
        level = [combine(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def normal(text: str | None) -> bytes:
    """The text in UTF-8 without the six characters of white space; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(None, _SPACE)


def same(a: bytes, b: bytes) -> bool:
    """Chunk by chunk, ending at the first that differs."""
    x, y = memoryview(a).cast("B"), memoryview(b).cast("B")  # a buffer of signed bytes never equals one of unsigned
    return len(a) == len(b) and all(x[i : i + CHUNK] == y[i : i + CHUNK] for i in range(0, len(a), CHUNK))


PRINTED = common.schema(doc_id=LONG, mark=LONG, n_points=LONG, fp_a=LONG, fp_b=LONG, n_bytes=LONG, text_sha256=STRING)
_KEY = ["fp_a", "fp_b", "n_bytes"]
PARTS = T.ArrayType(common.schema(part=LONG, fp_a=LONG, fp_b=LONG, n_bytes=LONG))


def _prints_of(docs: DataFrame, prints: Callable[[bytes], Print]) -> DataFrame:
    """PRINTED of (doc_id, mark, text) whose texts are not huge."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(PRINTED)
        for batch in batches:
            rows = []
            for x in batch.column(2):  # one text at a time: a batch may hold tens of MB
                text = x.as_py()
                data = normal(text)
                rows.append((len(text or ""), *prints(data), hashlib.sha256(data).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, type=f.type) for c, f in zip(columns, list(out)[2:], strict=True))], schema=out)
            x = text = data = batch = None
            common.give_back_memory()

    return docs.mapInArrow(printed, PRINTED)


def _prints_of_huge(docs: DataFrame, prints: Callable[[bytes], Print], huge: int) -> DataFrame:
    """The same for huge texts: parts are dealt over tasks, and a text's prints combined; it has few parts, as a text is under 2 GB."""

    @F.pandas_udf(common.schema(fp_a=LONG, fp_b=LONG, n_bytes=LONG))
    def hashed(parts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([prints(normal(t)) for t in parts], columns=_KEY, dtype="int64")

    @F.pandas_udf(common.schema(fp_a=LONG, fp_b=LONG, n_bytes=LONG))
    def combined(rows: pd.Series) -> pd.DataFrame:
        out = []
        for parts in rows:
            whole = (0, 0, 0)
            for x in parts:
                whole = combine(whole, (x["fp_a"], x["fp_b"], x["n_bytes"]))
            out.append(whole)
        return pd.DataFrame(out, columns=_KEY, dtype="int64")

    own = ["_row", "doc_id", "mark", "n_points", "text_sha256"]
    plain = F.translate("text", SPACE, "").cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "mark", F.length("text").cast("long").alias("n_points"), F.sha2(plain, 256).alias("text_sha256"), "text")
    numbers = F.sequence(F.lit(0), F.floor((F.col("n_points") - 1) / huge).cast("int"))
    parts = rows.select(*own, F.posexplode(F.transform(numbers, lambda k: F.substring("text", k * huge + 1, F.lit(huge)))).alias("part", "piece"))
    dealt = parts.repartition("_row", "part").select(*own, F.col("part").cast("long"), hashed("piece").alias("_print")).select(*own, F.struct("part", "_print.*").alias("_part"))
    whole = dealt.groupBy(*own).agg(F.sort_array(F.collect_list("_part")).cast(PARTS).alias("_parts"))
    return whole.select(*own, combined("_parts").alias("_print")).select("doc_id", "mark", "n_points", "_print.*", "text_sha256")


COMPARED = common.schema(doc_id=LONG, n_points=LONG, fp_a=LONG, fp_b=LONG, n_bytes=LONG, text_sha256=STRING, salt=LONG, rep=LONG, data=BINARY)
CLASSES = common.schema(fp_a=LONG, fp_b=LONG, n_bytes=LONG, salt=LONG, rep=LONG, variant=LONG)


def _compared(group: list[str], number: str, shape: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Numbers the different texts in `data` of each group of rows that follow one another, in the column `number`.

    A row is compared chunk by chunk with the group's different texts so far, of which there is one but for collisions.
    The shape's data, if it has that, is left with the first row of each different text only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, known = to_arrow_schema(shape), None, []
        for batch in batches:
            at, first = [], []
            keys = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in group), strict=True)
            for key, data in zip(keys, batch.column(batch.schema.get_field_index("data")), strict=True):
                if key != last:
                    last, known = key, []
                own = data.as_buffer()
                i = next((i for i, x in enumerate(known) if same(x, own)), len(known))
                if i == len(known):
                    known.append(own.to_pybytes())
                    first.append(True)
                else:
                    first.append(False)
                at.append(i)
            columns = []
            for f in out:
                column = pa.array(at, type=f.type) if f.name == number else batch.column(batch.schema.get_field_index(f.name))
                columns.append(pc.if_else(pa.array(first, pa.bool_()), column, pa.scalar(None, column.type)).cast(f.type) if f.name == "data" else column.cast(f.type))
            yield pa.RecordBatch.from_arrays(columns, schema=out)
            data = own = column = columns = batch = None
            common.give_back_memory()

    return run


def exact_duplicates(docs: DataFrame, prints: Callable[[bytes], Print] = fingerprint, huge: int = HUGE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256.

    Null and empty texts are equal to one another and to blank ones. Of equal texts the row with the most code points
    stays, then the one with the least doc_id; a null id comes last. Rows that share id and text: each counts in
    group_size, and each is kept if its id is. An empty table gives no rows; further columns are ignored.

    A candidate group of m rows is compared in about sqrt(m) parts, then one text of each part with the others, so no
    task gets more than about sqrt(m) rows of it.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")
    long = F.coalesce(F.length("text"), F.lit(0)) > huge
    printed = common.stored(_prints_of(docs.where(~long), prints).union(_prints_of_huge(docs.where(long), prints, huge)), "prints")
    # Tables that are joined are stored, so that Spark can split the rows of a large group.
    twice = common.stored(printed.groupBy(*_KEY).agg(F.count("*").alias("m")).where("m > 1"), "candidates")
    alone = printed.join(twice, _KEY, "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")

    # Stored before repeated rows are made one: that would go on in the join's own tasks, and Spark could not split them.
    paired = common.stored(printed.join(twice, _KEY), "paired")
    wanted = common.stored(paired.distinct(), "wanted").withColumnRenamed("doc_id", "_id").withColumnRenamed("mark", "_mark")
    # By shuffle at every size: the candidates grow with the documents, so no bound would let them be broadcast.
    texts = docs.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    salt = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.ceil(F.sqrt("m")))
    texts = texts.select("doc_id", "n_points", *_KEY, "text_sha256", salt.alias("salt"), F.translate(F.coalesce("text", F.lit("")), SPACE, "").cast("binary").alias("data"))
    part = [*_KEY, "salt"]
    compared = common.stored(texts.repartition(*part).sortWithinPartitions(*part).mapInArrow(_compared(part, "rep", COMPARED), COMPARED), "compared")
    firsts = compared.where("data is not null").select(*part, "rep", "data")
    classes = common.stored(firsts.repartition(*_KEY).sortWithinPartitions(*part, "rep").mapInArrow(_compared(_KEY, "variant", CLASSES), CLASSES), "classes")
    members = common.stored(compared.drop("data").join(classes, [*part, "rep"]).drop("salt", "rep"), "members")

    best = F.max(F.struct(F.col("n_points"), F.col("doc_id").isNotNull(), F.bitwise_not("doc_id").alias("last"))).alias("best")
    group = [*_KEY, "variant"]
    groups = common.stored(members.groupBy(*group).agg(F.count("*").alias("group_size"), best).select(*group, "group_size", F.bitwise_not("best.last").alias("keep_id")), "groups")
    rows = members.join(groups, group)
    return alone.union(rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))
