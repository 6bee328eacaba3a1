"""MinHash near-duplicates: universal hash minima, banding, checks on full sets, and connected components.

Texts with the same set of shingles are one class from the start, so thousands of exact copies cost one member; classes
are the nodes of the graph, whatever ids their documents have. Classes that share a band are linked to leaders of that
band only, never all with all, in a few rounds: at first to the band's own leaders, then to leaders of those that are
not in the band's largest component yet. Where a band still holds several components, the classes outside its largest
one are compared with all of the band, in blocks of bounded size and by their signatures first; so no link between
different components is lost, and none inside a component is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import common
from sparkloom.llm.common import BINARY, LONG, words
from sparkloom.llm.components import components

SHINGLE, BANDS, ROWS = 5, 32, 4
#: Rounds in which a band's classes are linked to leaders.
ROUNDS = 2
#: Classes of a band that are compared at once where it holds several components.
BLOCK = 1000
#: Shingles of a cluster that are compared at once on full sets, on average.
SET_BLOCK = 250_000
#: A signature's share of equal minima below which two sets are taken to be under 0.75: more than five deviations off.
SURELY_UNDER = 0.55
_MASK = np.uint64(2**64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACE = _mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word shingles, A-Z lower-cased; a shorter text is one shingle."""
    found = words(text.translate(_LOWER)) if text else []
    if not found:
        return np.empty(0, dtype=np.uint64)
    if len(found) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], dtype=np.uint64)
    known: dict[bytes, int] = {}
    order = np.fromiter((known.setdefault(w, len(known)) for w in found), dtype=np.int64, count=len(found))
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, known), dtype=np.uint64, count=len(known))[order]
    n = len(found) - k + 1
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total += _mixed(each[j : j + n] * _PLACE[j])
    return np.unique(_mixed(total))


#: A-Z to a-z; other letters stay as they are.
_LOWER = {i: i + 32 for i in range(65, 91)}
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**32 - 1, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32 - 1, (BANDS * ROWS, 1), dtype=np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of universal hashes a * x + b modulo 2**32 of a set's well mixed 64-bit hashes."""
    x, low = (hashes >> np.uint64(32)).astype(np.uint32), np.full(len(_A), 2**32 - 1, dtype=np.uint32)
    for start in range(0, len(x), 512):
        np.minimum(low, (x[None, start : start + 512] * _A + _B).min(axis=1), out=low)
    return low


SIGNED = common.schema(doc_id=LONG, n_shingles=LONG, set_key=BINARY, sketch=BINARY, bands=T.ArrayType(LONG))
SETS = common.schema(set_key=BINARY, hashes=BINARY)


def _signing():
    def each(names: list, texts: list) -> Iterator[dict]:
        counts, keys, sketches, bands = [], [], [], []
        for text in texts:
            s = shingles(text)
            counts.append(len(s))
            if not len(s):
                keys.append(None)
                sketches.append(None)
                bands.append(None)
                continue
            sig = signature(s)
            keys.append(xxhash.xxh3_128_digest(s.tobytes()))
            sketches.append(sig.astype(np.uint8).tobytes())
            bands.append(np.array([xxhash.xxh3_64_intdigest(sig[b * ROWS : (b + 1) * ROWS].tobytes(), seed=b) for b in range(BANDS)], dtype=np.uint64).view(np.int64))
        yield {"doc_id": names, "n_shingles": counts, "set_key": keys, "sketch": sketches, "bands": bands}

    return each


def _hash_sets():
    def each(names: list, texts: list) -> Iterator[dict]:
        sets = [shingles(t).tobytes() for t in texts]
        yield {"set_key": [xxhash.xxh3_128_digest(x) for x in sets], "hashes": sets}

    return each


@F.pandas_udf(T.BooleanType())
def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    def near(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
        return 100 * shared >= 75 * (len(x) + len(y) - shared)

    return pd.Series([near(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def _may_link(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=bool)
    same = [np.count_nonzero(np.frombuffer(x, dtype=np.uint8) == np.frombuffer(y, dtype=np.uint8)) for x, y in zip(a, b, strict=True)]
    return pd.Series(np.array(same) >= SURELY_UNDER * BANDS * ROWS)


def _sizes_allow(a: str, b: str) -> F.Column:
    return (100 * F.col(a) >= 75 * F.col(b)) & (100 * F.col(b) >= 75 * F.col(a))


def _merges(label: np.ndarray, probes: np.ndarray, near) -> list[tuple[int, int]]:
    """Pairs (i, j), i a probe, that join all rows that `near(i)` brings together; changes `label` so that joined rows have the same."""
    out = []
    for i in probes:
        at = near(i)
        at = at[label[at] != label[i]]
        while len(at):
            j = int(at[0])
            out.append((int(i), j))
            label[label == label[j]] = label[i]
            at = at[label[at] != label[i]]
    return out


def _pairs_of(node: np.ndarray, found: list[tuple[int, int]]) -> np.ndarray:
    at = np.array(found, dtype=np.int64).reshape(-1, 2)
    return np.sort(node[at], axis=1)


def _in_bands(part: pd.DataFrame) -> pd.DataFrame:
    """Of some bands' blocks: pairs (u, v) that join all classes which may be linked across components; at most one a row."""
    out = [np.empty((0, 2), dtype=np.int64)]
    part = part.sort_values(["key", "block"], ignore_index=True)
    of = part[["key", "block"]].to_numpy(dtype=np.int64)
    bounds = np.concatenate([[0], np.flatnonzero((of[1:] != of[:-1]).any(axis=1)) + 1, [len(part)]])
    sketch = np.frombuffer(b"".join(part["sketch"]), dtype=np.uint8).reshape(len(part), -1)
    n, label, node, probe = (part[c].to_numpy() for c in ("n_shingles", "label", "node", "probe"))
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        own, size, rows = label[a:z], n[a:z], sketch[a:z]

        def near(i: int, own=own, size=size, rows=rows) -> np.ndarray:
            at = np.flatnonzero((own != own[i]) & (100 * size >= 75 * size[i]) & (100 * size[i] >= 75 * size))
            return at[(rows[at] == rows[i]).sum(axis=1) >= SURELY_UNDER * BANDS * ROWS] if len(at) else at

        out.append(_pairs_of(node[a:z], _merges(np.arange(z - a), np.flatnonzero(probe[a:z]), near)))
    return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["u", "v"])


def _in_cluster(part: pd.DataFrame) -> pd.DataFrame:
    """Of a block of a cluster: pairs of 0.75 or more on full sets that join all components so linked there."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in part["hashes"]]
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(known), dtype=bool)

    def near(i: int) -> np.ndarray:
        mark[ids[ends[i] - size[i] : ends[i]]] = True
        shared = np.add.reduceat(mark[ids].astype(np.int64), ends - size)
        mark[ids[ends[i] - size[i] : ends[i]]] = False
        return np.flatnonzero(100 * shared >= 75 * (size + size[i] - shared))

    label = np.unique(part["label"], return_inverse=True)[1]
    return pd.DataFrame(_pairs_of(part["node"].to_numpy(), _merges(label, np.flatnonzero(part["probe"]), near)), columns=["u", "v"])


def _blocked(rows: DataFrame, weight: F.Column, block: int) -> DataFrame:
    """Deals the (key, node, label) of each key that has several labels over blocks of about `block` summed weights.

    A row is in one block of its key. Those outside the key's largest label visit all its blocks, as probes: so each of
    them meets every row of the key, and rows of the largest label, however many, never meet one another.
    """
    sums = rows.groupBy("key", "label").agg(F.sum(weight).alias("w"))
    sums = sums.groupBy("key").agg(F.count("*").alias("labels"), F.ceil(F.sum("w") / block).cast("int").alias("blocks"), F.max(F.struct("w", "label")).alias("major"))
    mixed = common.stored(sums.where("labels > 1").select("key", "blocks", F.col("major.label").alias("major")), "mixed")
    dealt = rows.join(mixed, "key").withColumn("probe", F.col("label") != F.col("major"))
    home = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    at = F.when(F.col("probe"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(home))
    return dealt.withColumn("block", F.explode(at)).drop("blocks", "major")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (u, v) of classes, those whose full shingle sets have a similarity of 0.75 or more."""
    sets = _sets(docs, classes, pairs.select(F.explode(F.array("u", "v")).alias("node")))
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    return both.where(_linked("a", "b")).select("u", "v")


def _sets(docs: DataFrame, classes: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, hashes): the full shingle sets of the classes in `needed`, from the text of their least document."""
    wanted = common.stored(classes.select("node", "set_key", "least").join(needed.select("node").distinct(), "node"), "wanted")
    texts = docs.join(wanted.select(F.col("least").alias("doc_id")).distinct(), "doc_id")
    found = common.over_texts(texts, _hash_sets, SETS, tidy=True).join(wanted.select("set_key", "node"), "set_key").select("node", "hashes")
    sets = common.stored(found, "sets")
    # Rows that share id and text give a set more than once.
    repeated = not sets.groupBy("node").count().where("count > 1").isEmpty()
    return sets.groupBy("node").agg(F.first("hashes").alias("hashes")) if repeated else sets


def _led(crowded: DataFrame, outside: DataFrame) -> DataFrame:
    """Pairs (u, v) of each band's classes and its leaders: the least and the most central of those `outside`."""
    least, central = F.min("node").alias("least"), F.min(F.struct((-F.col("company")).alias("c"), "node"))["node"].alias("central")
    leaders = common.stored(outside.groupBy("band").agg(least, central), "leaders")
    led = crowded.join(leaders, "band").select("node", "label", F.explode(F.array_distinct(F.array("least", "central"))).alias("lead")).where("lead <> node")
    return led.select(F.least("lead", "node").alias("u"), F.greatest("lead", "node").alias("v")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable) and kept (it is that one).

    A null, empty or blank text has no shingle and is linked with nothing, itself its component. A row with a null
    doc_id can be linked with nothing: its component is null and it is kept. Rows that share a doc_id are one document:
    all their texts' links are its links. Very long texts are read whole. An empty table gives no rows; further columns
    are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = common.stored(common.over_texts(docs, _signing, SIGNED, tidy=True), "signed")
    n = signed.count()
    with_set = signed.where("set_key is not null and doc_id is not null")
    first = [F.first(c).alias(c) for c in ("n_shingles", "sketch", "bands")]
    classes = common.stored(with_set.groupBy("set_key").agg(F.min("doc_id").alias("least"), *first).withColumn("node", F.monotonically_increasing_id()), "classes")
    member = common.stored(with_set.select("doc_id", "set_key").join(classes.select("set_key", "node"), "set_key").select("doc_id", "node").distinct(), "members", n)
    # A document's id links the classes of the rows that share it.
    shared = common.stored(member.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u < v").select("doc_id", "u"), "shared")
    links = common.stored(member.join(shared, "doc_id").select("u", F.col("node").alias("v")).where("u < v").distinct(), "links")

    # Signatures stay at home: only (band, node) is dealt, and only bands of several classes are kept. Tables that are
    # joined by a band are stored, so that Spark can split the rows of a large one.
    banded = classes.select("node", F.explode("bands").alias("band"))
    counts = common.stored(banded.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"), "counts")
    crowded = common.stored(banded.join(counts, "band"), "bands")
    # The class with most company in all of its bands is the most central: the text that edited copies stem from has
    # more than any copy, so they link with it even where they are under 0.75 among themselves.
    company = common.stored(crowded.groupBy("node").agg(F.sum("m").alias("company")), "company")
    crowded = common.stored(crowded.join(company, "node").select("band", "node", "company"), "bands")
    facts = classes.select("node", F.col("n_shingles").alias("n"), "sketch")
    found = None
    for k in range(ROUNDS):
        if k == 0:
            labelled = crowded.withColumn("label", F.col("node"))
            outside = labelled
        else:
            labelled = common.stored(crowded.join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "labelled")
            sums = labelled.groupBy("band", "label").agg(F.count("*").alias("w")).groupBy("band").agg(F.count("*").alias("labels"), F.max(F.struct("w", "label")).alias("major"))
            mixed = common.stored(sums.where("labels > 1").select("band", F.col("major.label").alias("major")), "mixed")
            labelled = common.stored(labelled.join(mixed, "band"), "labelled")
            outside = labelled.where("label <> major")
        pairs = common.stored(_led(labelled, outside), "led")
        pairs = pairs.join(facts.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv")), "v").join(facts.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su")), "u")
        pairs = common.stored(pairs.where(_sizes_allow("nu", "nv")).where(_may_link("su", "sv")).select("u", "v"), "pairs")
        if k:  # a pair within a component says nothing new
            label = labelled.select("node", "label").distinct()
            ends = [label.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in ("u", "v")]
            pairs = common.stored(pairs.join(ends[0], "u").join(ends[1], "v").where("lu <> lv").select("u", "v"), "pairs")
        links = common.stored(links.union(_verified(docs, classes, pairs)), "links")
        found = common.stored(components(links), "components")

    # Bands that still hold more than one component: by signatures, gather the classes that may be linked across them
    # into clusters, then compare a cluster's full sets. Either step puts out joining pairs only, so no more than rows.
    labelled = common.stored(crowded.join(found, "node", "left").select(F.col("band").alias("key"), "node", F.coalesce("component", "node").alias("label")), "labelled")
    rows = common.stored(_blocked(labelled, F.lit(1), BLOCK), "blocks")
    # Many small bands share a task's batch; its rows stay within a few blocks however many bands there are.
    batches = rows.count() // (4 * BLOCK) + 1
    rows = rows.join(classes.select("node", "n_shingles", "sketch"), "node").withColumn("_batch", F.pmod(F.xxhash64("key", "block"), F.lit(batches)))
    across = common.stored(rows.groupBy("_batch").applyInPandas(_in_bands, "u long, v long"), "across")
    if not across.isEmpty():
        clusters = components(across).join(classes.select("node", "n_shingles"), "node").join(found.withColumnRenamed("component", "label"), "node", "left")
        near = common.stored(clusters.select("node", "n_shingles", F.col("component").alias("key"), F.coalesce("label", "node").alias("label")), "clusters")
        rows = _blocked(near, F.col("n_shingles"), SET_BLOCK).join(_sets(docs, classes, near), "node")
        more = rows.groupBy("key", "block").applyInPandas(_in_cluster, "u long, v long")
        found = common.stored(components(links.union(more)), "components")

    # The least document of a class's component is that of all its documents, and of every row that shares their ids.
    roots = classes.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    roots = common.stored(roots, "roots")
    least = common.stored(roots.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = common.stored(roots.join(least, "root").select("node", "component_id"), "named")
    at = common.stored(member.join(named, "node").groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "documents")
    out = signed.select("doc_id", "n_shingles").join(at, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each component, with their own columns.

    Rows that share a doc_id are one document, so all of them stay or go.
    """
    own, found = docs.columns, near_duplicates(docs).where("not kept").select("doc_id").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col("doc_id").alias("doc_id"))
    return rows.join(found, "doc_id", "left_anti").select("_row.*")
