"""Quality rules: statistics of whole texts, and a decision list learned from labels by sequential covering."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import common
from sparkloom.llm.common import LONG, SPACE, words

SYMBOLS = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper_words")
#: Ratios that a learned condition may test; each is an expression over the counts, true alike in Spark and in pandas.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"), "chars_per_word": ("word_chars", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeat_words": ("n_repeat_words", "n_words"), "distinct_words": ("n_distinct_words", "n_words"), "upper_words": ("n_upper_words", "n_words"), "words_per_line": ("n_words", "n_lines"),
}


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text; all 0 for null."""
    if not text:
        return (0,) * len(COUNTS)
    found = words(text)
    n, ids = len(found), {}
    order = np.fromiter((ids.setdefault(w, len(ids)) for w in found), dtype=np.int64, count=n)
    repeated = 0
    if n > 3:
        # A window's number; ids of windows of two come first so that the numbers stay within 64 bits.
        pairs = order[:-1] * len(ids) + order[1:]
        _, pair_ids = np.unique(pairs, return_inverse=True)
        _, window, count = np.unique(pair_ids[:-1].astype(np.int64) * len(ids) + order[2:], return_inverse=True, return_counts=True)
        twice = count[window] > 1
        covered = np.zeros(n, dtype=bool)
        for shift in range(3):
            covered[shift : n - 2 + shift] |= twice
        repeated = int(covered.sum())
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    chars = len(text) - sum(map(text.count, SPACE))
    return n, chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated, len(lines), len(ids), sum(map(bytes.isupper, found))


def with_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds COUNTS, over whole texts; with `keep`, only those columns and the counts."""

    @F.pandas_udf(common.schema(**dict.fromkeys(COUNTS, LONG)))
    def counts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in common.tidily(texts):
            yield pd.DataFrame([text_counts(t) for t in batch], columns=COUNTS, dtype="int64")

    # Not deterministic by its word, so that a filter on the counts stays above them and a join, and they are made once.
    once = counts.asNondeterministic()
    others = [c for c in (keep if keep is not None else docs.columns) if c not in COUNTS]
    return docs.select(*others, once(F.col(text)).alias("_counts")).select(*others, "_counts.*")


def base_failed() -> F.Column:
    """Too short, or for more than half made of words in repeated windows of three."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(name: str) -> F.Column:
    above, below = RATIOS[name]
    return F.col(above) / F.greatest(F.col(below), F.lit(1))


Rule = list[tuple[str, str, float]]


def _matches(x: pd.DataFrame, rule: Rule) -> np.ndarray:
    hit = np.ones(len(x), dtype=bool)
    for name, sign, cut in rule:
        hit &= (x[name] >= cut if sign == ">=" else x[name] <= cut).to_numpy()
    return hit


def _grow(x: pd.DataFrame, y: np.ndarray, weight: np.ndarray, cuts: dict[str, np.ndarray], longest: int) -> Rule:
    """Adds the threshold of most information gain until no rejected example is mixed with kept ones."""
    rule: Rule = []
    hit = np.ones(len(x), dtype=bool)
    while len(rule) < longest and weight[hit & ~y].sum() > 0:
        p0, n0 = weight[hit & y].sum(), weight[hit & ~y].sum()
        best = (1e-9, None)
        for name, at in cuts.items():
            v, w, t = x[name].to_numpy()[hit], weight[hit], y[hit]
            place = np.searchsorted(at, v, "right")
            p = np.bincount(place, w * t, len(at) + 1)
            n = np.bincount(place, w * ~t, len(at) + 1)
            above_p, above_n = p[::-1].cumsum()[::-1][1:], n[::-1].cumsum()[::-1][1:]  # v >= at[i]
            below = np.searchsorted(at, v, "left")
            p, n = np.bincount(below, w * t, len(at) + 1), np.bincount(below, w * ~t, len(at) + 1)
            below_p, below_n = p.cumsum()[:-1], n.cumsum()[:-1]  # v <= at[i]
            for sign, ps, ns in ((">=", above_p, above_n), ("<=", below_p, below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - np.log2(p0 / (p0 + n0))), 0)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], (name, sign, float(at[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        hit &= _matches(x, [best[1]])
    return rule


def learn(x: pd.DataFrame, reject: np.ndarray, precision: float = 0.9, least: int = 5, longest: int = 4, most_rules: int = 16, seed: int = 7) -> list[Rule]:
    """Sequential covering: each rule grows on two thirds of the rows that are left, is pruned on the last third and stays if it is precise there.

    Returns the ordered rules; a row that none matches is kept. No rule is learned without at least `least` rejected rows.
    Settings of the model: a rule has at most `longest` conditions and the list at most `most_rules` rules; it ends with
    the first rule that is not precise.
    """
    rules: list[Rule] = []
    x, reject = x.reset_index(drop=True), np.asarray(reject, dtype=bool)
    part = np.random.default_rng(seed).random(len(x)) < 2 / 3
    left = np.ones(len(x), dtype=bool)
    while len(rules) < most_rules and (left & reject & part).sum() >= least:
        grow, prune = left & part, left & ~part
        cuts = {c: np.unique(np.quantile(x[c][grow], np.linspace(0, 1, 129))) for c in x.columns}
        rule = _grow(x[grow].reset_index(drop=True), reject[grow], np.ones(int(grow.sum())), cuts, longest)
        if not rule:
            break

        def worth(r: Rule, rows: np.ndarray = prune) -> tuple[float, int]:
            hit = _matches(x, r) & rows
            p, n = int((hit & reject).sum()), int((hit & ~reject).sum())
            return (p - n) / max(p + n, 1), p

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (*worth(r), -len(r)))
        hit = _matches(x, rule)
        p, n = int((hit & prune & reject).sum()), int((hit & prune & ~reject).sum())
        p_all, n_all = int((hit & left & reject).sum()), int((hit & left & ~reject).sum())
        if p + n == 0 or p < precision * (p + n) or p_all < precision * (p_all + n_all) or p_all < least:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> F.Column:
    """The decision list as one conditional expression: the first rule that matches rejects; else the row is kept."""
    out = None
    for rule in rules:
        test = None
        for name, sign, cut in rule:
            one = ratio(name) >= cut if sign == ">=" else ratio(name) <= cut
            test = one if test is None else test & one
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> list[Rule]:
    """Rules from at most `most` labelled documents (by a hash of their ids), of those that pass the base rules. Label 0 rejects."""
    chosen = common.sampled_labels(labels, "quality", most)
    # Of rows that share an id, one text is taken, so that no more than `most` reach the driver.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    rows = with_counts(texts, keep=["doc_id", "label"]).where(~base_failed())
    table = rows.select("doc_id", "label", *[ratio(r).alias(r) for r in RATIOS]).toPandas().sort_values("doc_id", ignore_index=True)
    return learn(table[list(RATIOS)].astype(float), table["label"].to_numpy() == 0)


def quality(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed and kept.

    A null or empty text has no words and fails; a null id stays null; repeated rows are judged alike; further columns
    are ignored. An empty table gives no rows. Without labels there are no learned rules and the base rules decide.
    """
    return with_counts(docs.select("doc_id", "text"), keep=["doc_id"]).withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that pass, with their own columns."""
    own = docs.columns
    judged = with_counts(docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col("text").alias("_text")), "_text", ["_row"])
    return judged.where(~base_failed() & verdict(rules)).select("_row.*")
