"""Mixing sources to target weights: a curriculum whose weights change over training.

A source's schedule is a piecewise linear weight over training time 0..1. Its integral is the source's share of the
mix, shares are filled up to a number of repeats, and the running integral, inverted, says when a source's n-th word is
due. Documents of a source stand in the order of a hash of their ids, pass after pass, and range-sorting all copies by
their time gives the training order. The copy at which a source's target is reached gives its first words only, so that
words add up to the target rounded down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import common

Schedule = list[tuple[float, float]]
#: The production schedules of the first, second and third source, and so on around: (time, weight), integrals 5, 2 and 1.
SCHEDULES: list[Schedule] = [[(0.0, 6.0), (0.5, 5.0), (1.0, 4.0)], [(0.0, 1.5), (1.0, 2.5)], [(0.0, 0.5), (1.0, 1.5)]]
REPEATS = 3
#: Sources' rows are summed over this many slices of the hash before any window sees them.
SLICES = 1024


def integral(schedule: Schedule) -> np.ndarray:
    """Rows of (time, weight, weight summed up to then)."""
    t, w = np.array(schedule, dtype=float).T
    if t[0] != 0 or t[-1] != 1 or (np.diff(t) <= 0).any() or (w < 0).any():
        raise ValueError("a schedule goes from time 0 to 1 and has no negative weight")
    return np.column_stack([t, w, np.concatenate([[0], np.cumsum(np.diff(t) * (w[1:] + w[:-1]) / 2)])])


def due(schedule: Schedule, share: np.ndarray) -> np.ndarray:
    """The times at which the summed weight reaches these shares (0..1) of its total: within a piece the root of a quadratic."""
    t, w, total = integral(schedule).T
    want = np.clip(share, 0, 1) * total[-1]
    i = np.clip(np.searchsorted(total, want, "right") - 1, 0, len(t) - 2)
    a, b, c = (w[i + 1] - w[i]) / (t[i + 1] - t[i]) / 2, w[i], want - total[i]
    root = np.sqrt(np.maximum(b * b + 4 * a * c, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        step = np.where(b + root > 0, 2 * c / (b + root), 0.0)
    return np.clip(t[i] + step, t[i], t[i + 1])


def targets(sizes: DataFrame, schedules: list[Schedule] = SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """Each source's target: its share of all words, at most `repeats` times its size, the excess shared again by weight.

    Takes and returns one row per source. The n-th source by code point (null last) has the n-th schedule, around.
    The level at which sum(min(repeats * size, level * weight)) is the total follows from one sort by size over weight.
    """
    weights = F.array(*[F.lit(float(integral(s)[-1, 2])) for s in schedules])
    ranked = sizes.withColumn("rank", (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1).cast("int"))
    ranked = ranked.withColumn("weight", F.element_at(weights, (F.col("rank") % len(schedules) + 1).cast("int")))
    cap = F.lit(float(repeats)) * F.col("source_size")
    by_fill = Window.orderBy(cap / F.col("weight"), "rank")
    total = F.sum("source_size").over(Window.partitionBy())
    filled = F.coalesce(F.sum(cap).over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = ranked.withColumn("_level", (total - filled) / left).withColumn("_open", cap > F.col("_level") * F.col("weight"))
    # Sources before the first open one are full; all others share what is left at that one's level.
    level = F.min(F.when(F.col("_open"), F.struct(cap / F.col("weight"), "rank", "_level"))).over(Window.partitionBy())["_level"]
    return ranked.withColumn("_at", level).withColumn("target", F.when(F.col("_at").isNull() | (cap <= F.col("_at") * F.col("weight")), cap).otherwise(F.col("_at") * F.col("weight"))).drop("_level", "_open", "_at")


def placed(docs: DataFrame, schedules: list[Schedule] = SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """doc_id, source, mark (a hash of the text), size, source_size, target, before (words of its source before it) and rank, one row per document.

    A null source is a source of its own; a null text has size 0; repeated rows count each. No row is lost.
    """
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("mark"), common.n_words(F.col("text")).alias("size")).withColumn("_key", F.xxhash64(F.col("doc_id").cast("string"), F.lit("order")))
    sized = common.stored(sized.withColumn("_slice", F.pmod("_key", F.lit(SLICES)).cast("int")), "sizes")
    sums = sized.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    slices = Window.partitionBy("source").orderBy("_slice")
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(slices.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per_source = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), schedules, repeats)
    sums = sums.alias("a").join(per_source.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "source_size", "target", "rank")
    inside = Window.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = rows.alias("d").join(sums.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d._slice") == F.col("s._slice")))
    return both.select("d.doc_id", "d.source", "d.mark", "d.size", "s.source_size", "s.target", (F.col("d._inside") + F.col("s._before")).alias("before"), "s.rank")


def dealt(docs: DataFrame, schedules: list[Schedule] = SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """The rows of placed() with `copies`: copy (from 0), words (its first ones that are taken) and position of each copy in the mix.

    The position is the time in training (0..1) at which the copy's first word is due. A copy is taken as far as its
    words are due before the target is reached; a document without words takes no part.
    """
    named = [list(map(tuple, s)) for s in schedules]

    @F.pandas_udf("array<double>")
    def times_of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rank, shares in parts:
            n = shares.map(len).to_numpy(dtype=np.int64)
            share, which = np.concatenate([np.zeros(0), *shares]), np.repeat(rank.to_numpy(dtype=np.int64), n) % len(named)
            out = np.zeros(len(share))
            for k in np.unique(which):
                out[which == k] = due(named[k], share[which == k])
            yield pd.Series(np.split(out, np.cumsum(n)[:-1]) if len(n) else [], dtype=object)

    rows = placed(docs, schedules, repeats)
    start = lambda k: k.cast("long") * F.col("source_size") + F.col("before")
    words = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - start(k))).cast("long")
    taken = F.transform(F.sequence(F.lit(0), F.lit(int(repeats) - 1)), lambda k: F.struct(k.alias("copy"), words(k).alias("words"), start(k).alias("start")))
    rows = rows.withColumn("_taken", F.filter(taken, lambda c: c["words"] > 0))
    rows = rows.withColumn("_times", times_of(F.col("rank"), F.transform("_taken", lambda c: c["start"] / F.col("target"))))
    both = F.zip_with("_taken", "_times", lambda c, t: F.struct(c["copy"].alias("copy"), c["words"].alias("words"), t.alias("position")))
    return rows.withColumn("copies", both).drop("_taken", "_times")


def mix(docs: DataFrame, schedules: list[Schedule] = SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """One row per document, range-sorted by its first position: doc_id, size, source_size, target, taken and positions.

    `taken` are the words that the mix takes of it in all copies and `positions` the times in training of these copies,
    both of the very copies that mixed_documents() puts out. Documents that are not taken stand last.
    """
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    rows = dealt(docs, schedules, repeats).select("doc_id", "size", "source_size", F.col("target").cast("double"), taken.alias("taken"), F.col("copies.position").alias("positions"))
    return rows.sort(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")


def copies(docs: DataFrame, schedules: list[Schedule] = SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """The mix: doc_id, copy (from 0), words and position of each copy that is taken."""
    return dealt(docs, schedules, repeats).select("doc_id", F.inline("copies"))


def first_words(text: F.Column, n: F.Column) -> F.Column:
    """A text up to the end of its n-th word, with the white space before and between as it is."""
    each = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(each, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, schedules: list[Schedule] = SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """The documents' own columns, a row per copy, range-sorted by position in training; text has the words that are taken.

    Rows that share a doc_id take the copies of their own source and text; among equal rows, which takes which is open.
    """
    own, key = docs.columns, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key")
    each = dealt(docs, schedules, repeats).select(key, F.struct("source", "mark", "size", "copies").alias("_deal"))
    deals = each.groupBy("_key").agg(F.sort_array(F.collect_list("_deal")).alias("_deals"))
    keyed = docs.select(key, F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.xxhash64("text").alias("_mark"))
    rows = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy("_source", "_mark"))).join(deals, "_key")
    rows = rows.withColumn("_deal", F.element_at("_deals", F.col("_nth"))).select("_row", "_id", F.col("_deal.size").alias("_size"), F.explode("_deal.copies").alias("_copy"))
    rows = rows.sort("_copy.position", "_id", "_copy.copy")
    whole = F.col("_row.text")
    text = F.when(F.col("_copy.words") < F.col("_size"), first_words(whole, F.col("_copy.words"))).otherwise(whole)
    return rows.select(*[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in own])
