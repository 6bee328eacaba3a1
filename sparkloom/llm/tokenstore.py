"""Token ids in a content-addressed store.

A rolling hash over the ids cuts each document's stream into chunks where the content says so; a chunk is addressed by
its digest and stored once; a document is a recipe of digests; a Merkle root over a recipe's leaves, and one over all
documents of a manifest row, verify what is read back.

Layout of a store: `recipes` (doc_id, n_tokens, digests, root; in ascending doc_id), `chunks` (digest, ids), `manifest`
(part, cell, first_id, last_id, n_docs, n_tokens, root, width). Ids are little-endian integers of the store's width, 2
bytes where the vocabulary allows, else 4.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import common, tokens
from sparkloom.llm.common import BINARY, LONG

END_ID = 1
#: Chunks have at least LEAST, about LEAST + 2 ** BITS and at most MOST ids; the rolling hash sees SPAN ids.
LEAST, MOST, BITS, SPAN = 64, 1024, 8, 16
DIGEST = 16
#: Documents of a manifest row, about.
DOCS_A_ROW = 1000
_GEAR = np.random.default_rng(4102444800).integers(0, 2**64 - 1, 1 << 16, dtype=np.uint64)


def cuts(ids: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Of streams that follow one another and end at `ends`: the ends of all chunks, and each stream's number of them.

    A chunk ends where the hash of the last SPAN ids has BITS zero bits, within LEAST and MOST, or with its stream. The
    hash, a sum of shifted gears, is doubled in span from one id on; it sees no other stream, as LEAST is over SPAN.
    """
    rolled, span = _GEAR[ids & 0xFFFF], 1
    while span < SPAN:
        rolled[span:] += rolled[:-span] << np.uint64(span)
        span *= 2
    marks = (np.flatnonzero((rolled >> np.uint64(64 - BITS)) == 0) + 1).tolist()
    out, counts, start, i = [], [], 0, 0
    for n in ends.tolist():
        before = len(out)
        while n - start > LEAST:
            i = bisect_left(marks, start + LEAST, i)
            start = min(marks[i] if i < len(marks) else n, start + MOST, n)
            out.append(start)
        if start < n:
            out.append(n)
            start = n
        counts.append(len(out) - before)
    return out, counts


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of digests; an odd one out moves up as it is; the empty tree's root is the digest of nothing."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=DIGEST).digest() for x in leaves] or [hashlib.blake2b(b"", digest_size=DIGEST).digest()]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[i : i + 2]), digest_size=DIGEST).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def digest(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=DIGEST).digest()


def width_of(tokenizer: str) -> int:
    """Bytes that an id of a tokenizer file needs: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4


STAGED = common.schema(doc_id=LONG, n_tokens=LONG, digests=BINARY, root=BINARY, digest=BINARY, ids=BINARY)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encodes every text once, whole, and writes recipes, unique chunks and the manifest under `path`.

    A null text is empty: its ids are the end id alone. Repeated rows give a recipe each.
    """
    spark, width = docs.sparkSession, width_of(tokenizer)
    kind = f"<u{width}"

    def staged():
        encode = tokens.encoder(tokenizer, False, kind).encode
        end, seen = np.array([end_id], dtype=kind).tobytes(), set()

        def each(names: list, texts: list) -> Iterator[dict]:
            for a, z in tokens.in_slices(texts):
                streams = encode(texts[a:z])
                joined = end.join([*streams, b""])
                length = np.array([len(x) // width + 1 for x in streams])
                ends, counts = cuts(np.frombuffer(joined, dtype=kind), np.cumsum(length))
                recipes, new, at, start = [], {}, 0, 0
                for count in counts:
                    recipe = []
                    for to in ends[at : at + count]:
                        chunk = joined[width * start : width * to]
                        key = digest(chunk)
                        recipe.append(key)
                        start = to
                        if key not in seen:  # a task sends a chunk once, as far as it remembers
                            seen.add(key)
                            new[key] = chunk
                    at += count
                    recipes.append(recipe)
                n, m = z - a, len(new)
                if len(seen) > 200_000:
                    seen.clear()
                none, nothing = [None] * n, [None] * m
                yield {
                    "doc_id": names[a:z] + nothing, "n_tokens": length.tolist() + nothing, "digests": [b"".join(r) for r in recipes] + nothing,
                    "root": [merkle(r) for r in recipes] + nothing, "digest": none + list(new), "ids": none + list(new.values()),
                }

        return each

    staged_at = f"{path}/staged"
    common.over_texts(docs, staged, STAGED).write.option("compression", "zstd").parquet(staged_at)
    rows = spark.read.schema(STAGED).parquet(staged_at)
    chunks = rows.where("digest is not null").groupBy("digest").agg(F.first("ids").alias("ids"))
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = rows.where("digest is null").select("doc_id", "n_tokens", "digests", "root")
    recipes.sort("doc_id", "root").write.option("compression", "zstd").parquet(f"{path}/recipes")
    common.remove(spark, staged_at)
    _manifest(spark.read.parquet(f"{path}/recipes")).withColumn("width", F.lit(width)).write.parquet(f"{path}/manifest")


@F.pandas_udf(BINARY)
def _root_of(leaves: pd.Series) -> pd.Series:
    return pd.Series([merkle([bytes(x) for x in row]) for row in leaves], dtype=object)


def _manifest(recipes: DataFrame) -> DataFrame:
    """A row for each span of ids: its documents, tokens and the Merkle root over its recipes' roots in order.

    Equal recipes under one id are one leaf that holds their number. A span of many more recipes than ids (null ids are
    one span, and an id may be repeated) falls into cells by its leaves' digests, so no row gathers much more than
    4 * DOCS_A_ROW leaves.
    """
    part = F.floor(F.col("doc_id") / DOCS_A_ROW).alias("part")
    # The id as text and the number are part of the leaf: a moved or repeated recipe changes the root.
    leaf = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("n").cast("string"), F.lit(":"), F.hex("root"))))
    each = recipes.groupBy(part, "doc_id", "root").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).withColumn("leaf", leaf)
    sizes = each.groupBy("part").agg(F.ceil(F.count("*") / DOCS_A_ROW).alias("cells")).where("cells > 4").withColumnRenamed("part", "_part")
    dealt = each.join(sizes, F.col("part").eqNullSafe(F.col("_part")), "left").withColumn("cell", F.coalesce(F.pmod(F.xxhash64("leaf"), F.col("cells")), F.lit(0)))
    spans = dealt.groupBy("part", "cell").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum("n").alias("n_docs"), F.sum("tokens").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("doc_id", "root", "leaf"))).alias("leaves"),
    )
    return spans.select("part", "cell", "first_id", "last_id", "n_docs", "n_tokens", _root_of(F.col("leaves.leaf")).alias("root"))


def checked_recipes(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The recipes of a store, after the manifest has been made again from them and compared, and the width of ids.

    Raises where a recipe is lost, changed, moved or there twice.
    """
    recipes, stored = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    facts = F.struct("first_id", "last_id", "n_docs", "n_tokens", "root")
    now = _manifest(recipes).select(F.col("part").alias("p"), F.col("cell").alias("c"), facts.alias("now"))
    both = stored.select("part", "cell", facts.alias("then")).join(now, F.col("part").eqNullSafe(F.col("p")) & (F.col("cell") == F.col("c")), "full")
    if wrong := both.where(~F.col("now").eqNullSafe(F.col("then"))).select(F.coalesce("part", "p")).head():
        raise RuntimeError(f"the recipes of part {wrong[0]} are not those of the manifest")
    first = stored.select("width").head()
    return recipes, first[0] if first else 2


# CRC-32 of two byte strings together, from theirs: crc(ab) = crc(a) * x ** (8 * len(b)) + crc(b) in polynomials over GF(2).
_POLY = np.uint32(0xEDB88320)


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros_like(b)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def _squares() -> list[np.uint32]:
    x = np.array([1 << 30], dtype=np.uint32)
    out = []
    for _ in range(64):
        out.append(x[0])
        x = _multiply(x, x)
    return out


_SQUARES = _squares()


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """crc * x ** (8 * n_bytes) of each."""
    out, bits = crc.astype(np.uint32), n_bytes.astype(np.int64) * 8
    for k in range(int(bits.max(initial=0)).bit_length()):
        at = (bits >> k) & 1 == 1
        if at.any():
            out[at] = _multiply(np.full(int(at.sum()), _SQUARES[k], dtype=np.uint32), out[at])
    return out


def _leaf_facts(width: int):
    def facts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, ids in zip(part["digest"], part["ids"], strict=True):
                if digest(ids) != bytes(key):
                    raise RuntimeError("a stored chunk does not have its digest")
                rows.append((key, len(ids) // width, zlib.crc32(np.frombuffer(ids, dtype=f"<u{width}").astype("<u4").tobytes())))
            yield pd.DataFrame(rows, columns=["digest", "n", "crc"])

    return facts


_SUMMED = "doc_id long, n_tokens long, ids_crc32 long"


def _summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of documents with their chunks' facts in order: the crc of all ids, once lengths and Merkle root are found true.

    The chunks of a batch are shifted to their places all at once.
    """
    for part in parts:
        if not len(part):
            continue
        count = part["n"].map(len).to_numpy()
        n, crc = np.concatenate(part["n"].tolist()).astype(np.int64), np.concatenate(part["crc"].tolist()).astype(np.uint32)
        first = np.cumsum(count) - count
        total, through = np.add.reduceat(n, first), np.cumsum(n)
        after = np.repeat(through[first + count - 1], count) - through
        wrong = total != part["n_tokens"].to_numpy()
        for i, (root, digests) in enumerate(zip(part["root"], part["digest"], strict=True)):
            if wrong[i] or merkle([bytes(x) for x in digests]) != bytes(root):
                raise RuntimeError(f"document {part['id'].iloc[i]} can't be rebuilt from the store")
        sums = np.bitwise_xor.reduceat(shifted(crc, 4 * after), first)
        yield pd.DataFrame({"doc_id": pd.array([None if x is None else int(x) for x in part["id"]], dtype="Int64"), "n_tokens": part["n_tokens"], "ids_crc32": sums.astype(np.int64)})


def _references(recipes: DataFrame) -> DataFrame:
    """A row per document and chunk, in order by `at`; the row number tells apart rows that share an id."""
    rows = recipes.withColumn("_row", F.monotonically_increasing_id())
    at = F.explode(F.sequence(F.lit(0), F.floor(F.length("digests") / DIGEST).cast("int") - 1))
    return rows.select("_row", "doc_id", "n_tokens", "root", "digests", at.alias("at")).select("_row", "doc_id", "n_tokens", "root", "at", F.substring("digests", F.col("at") * DIGEST + 1, F.lit(DIGEST)).alias("digest"))


def _there(column: str) -> F.Column:
    """The column of a joined chunk, or an error where the store has no such chunk."""
    return F.when(F.col(column).isNull(), F.raise_error(F.concat(F.lit("the store has lost chunk "), F.hex("digest")))).otherwise(F.col(column))


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """From the files alone: doc_id, start, n_tokens and ids_crc32 of each document.

    Recipes are held against the manifest, chunks against their digests and each document's chunks against its root;
    raises where anything is lost or changed.
    """
    recipes, width = checked_recipes(spark, path)
    facts = spark.read.parquet(f"{path}/chunks").mapInPandas(_leaf_facts(width), "digest binary, n long, crc long")
    found = _references(recipes).join(facts, "digest", "left").select("_row", "doc_id", "n_tokens", "root", "at", "digest", _there("n").alias("n"), "crc")
    docs = found.groupBy("_row", "doc_id", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("at", "n", "crc", "digest"))).alias("leaves"))
    summed = docs.select(F.col("doc_id").cast("string").alias("id"), "n_tokens", "root", "leaves.n", "leaves.crc", "leaves.digest").mapInPandas(_summed, _SUMMED)
    return common.running_total(common.stored(summed, "sums"), ["doc_id", "n_tokens", "ids_crc32"], "n_tokens", "start").select("doc_id", "start", "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids): every document's ids rebuilt from its recipe and checked as in read_sums()."""
    recipes, width = checked_recipes(spark, path)
    rows = _references(recipes).join(spark.read.parquet(f"{path}/chunks"), "digest", "left").select("_row", "doc_id", "root", "at", _there("ids").alias("ids"))
    rows = rows.groupBy("_row", "doc_id", "root").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("leaves"))

    @F.pandas_udf("array<long>")
    def rebuilt(root: pd.Series, leaves: pd.Series) -> pd.Series:
        out = []
        for want, parts in zip(root, leaves, strict=True):
            ids = [bytes(x["ids"]) for x in parts]
            if merkle([digest(x) for x in ids]) != bytes(want):
                raise RuntimeError("a document can't be rebuilt from the store")
            out.append(np.frombuffer(b"".join(ids), dtype=f"<u{width}").astype(np.int64))
        return pd.Series(out)

    return rows.select("doc_id", rebuilt("root", "leaves").alias("ids"))


def store_and_verify(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes a store of `docs` in the shared folder and reads it back: doc_id, start, n_tokens and ids_crc32 per document.

    Ids follow one another in ascending doc_id, a null id first; rows that share an id, by length. An empty table gives
    no rows; further columns are ignored.
    """
    path = common.scratch_path(docs.sparkSession, "tokens")
    write_store(docs, path, tokenizer, end_id)
    return read_sums(docs.sparkSession, path)
