"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's score is a logistic function of its words; a document is toxic if any sentence is, so its score is the
noisy-or of theirs. Gradients of the documents' likelihood pass through the noisy-or to the words.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import common
from sparkloom.llm.common import DOUBLE, INT, LONG

#: A word, or a mark that ends a sentence.
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
ENDS = frozenset(".!?\n")


#: Letters of the beginnings that count as features beside whole words, so that inflected forms share evidence.
BEGINNING = 4


def features(token: str) -> tuple[str, ...]:
    """The word itself, and for a longer one its beginning with a mark."""
    return (token, token[:BEGINNING] + "~") if len(token) > BEGINNING else (token,)


class _Logits(dict):
    """The summed weight of a token's features, computed when first asked for; not a number for a sentence's end."""

    def __init__(self, weights: dict[str, float]):
        super().__init__(dict.fromkeys(ENDS, np.nan))
        self.weights = weights

    def __missing__(self, token: str) -> float:
        if len(self) > 500_000:
            self.clear()
            self.update(dict.fromkeys(ENDS, np.nan))
        out = self[token] = sum(self.weights.get(f, 0.0) for f in features(token))
        return out


class Model:
    """Feature weights and a bias; score() gives a text's noisy-or."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.logits = _Logits(weights)

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def sentence_logits(self, text: str | None) -> np.ndarray:
        """A logit for each sentence that has a word; a word that follows itself counts once."""
        found = TOKEN.findall(text.lower()) if text else []
        value = np.fromiter(map(self.logits.__getitem__, found), dtype=float, count=len(found))
        again = np.fromiter(map(eq, found, islice(found, 1, None)), dtype=bool, count=max(len(found) - 1, 0))
        ends = np.isnan(value)
        word = ~ends
        if not word.any():
            return np.empty(0)
        sentence = np.cumsum(ends)[word]
        value[1:][again & word[1:]] = 0.0
        n = np.bincount(sentence)
        return self.bias + np.bincount(sentence, value[word])[n > 0]

    def score(self, text: str | None) -> float:
        """1 - product of (1 - p) over sentences; 0 for a text without words."""
        z = self.sentence_logits(text)
        return float(-np.expm1(-np.logaddexp(0, z).sum()))

    def locate(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, score) of the sentences that score `least` or more, or else of the one that scores most.

        So a document that many middling sentences make toxic has a sentence, too; a text without words has none.
        """
        out, start, top = [], 0, None
        if not text:
            return out
        for m in [*re.finditer(r"[.!?\n]", text), None]:
            end = m.end() if m else len(text)
            z = self.sentence_logits(text[start:end])
            if len(z):
                found = (start, end, float(1 / (1 + np.exp(-z[0]))))
                top = found if top is None or found[2] > top[2] else top
                if found[2] >= least:
                    out.append(found)
            start = end
        return out or ([top] if top else [])


def loss_and_gradient(theta: np.ndarray, sentence: np.ndarray, word: np.ndarray, doc: np.ndarray, plain: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean weighted -log likelihood of the documents' labels under the noisy-or, and its gradient.

    theta: weights of the features, then the bias; feature word[i] stands in sentence[i], which is in doc[sentence[i]];
    plain: how many more sentences, without a feature, each document has.
    """
    n = len(theta) - 1
    z = theta[-1] + np.bincount(sentence, theta[word], len(doc))
    p, pb = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-1]))
    none = np.bincount(doc, np.logaddexp(0, z), len(y)) + plain * np.logaddexp(0, theta[-1])  # -log of no toxic sentence
    loss = weight * np.where(y == 1, -np.log(np.maximum(-np.expm1(-none), 1e-12)), none)
    # d(loss)/d(none): 1 for a clean document, -exp(-none) / (1 - exp(-none)) for a toxic one
    slope = weight * np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(none, 50)), 1e-6), 1.0)
    gz = slope[doc] * p
    grad = np.append(np.bincount(word, gz[sentence], n), gz.sum() + (slope * plain).sum() * pb) / len(y)
    return loss.sum() / len(y), grad


def fit(texts: list[str | None], toxic: np.ndarray, most_words: int = 2000, rounds: int = 150, l2: float = 1e-4, least_docs: int = 3) -> Model:
    """Learns weights of the `most_words` features whose document counts tell most, by Adam on the whole sample.

    Settings of the model: features in fewer than `least_docs` documents are not used, and weights under 0.05 are left
    out of it.
    """
    y = np.asarray(toxic, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Model({}, float(np.log(rate / (1 - rate)) - 4))
    # A document's tokens are kept as numbers; a sentence's end is -1.
    split, counts, number = [], (Counter(), Counter()), defaultdict(lambda: len(number))
    for t, label in zip(texts, y, strict=True):
        found = TOKEN.findall(t.lower()) if t else []
        split.append(np.fromiter((-1 if x in ENDS else number[x] for i, x in enumerate(found) if i == 0 or x != found[i - 1] or x in ENDS), dtype=np.int32))
        counts[int(label)].update({f for x in set(found) - ENDS for f in features(x)})
    n0, n1 = len(y) - y.sum(), y.sum()
    told = []
    for w in counts[1].keys() | counts[0].keys():
        a, b = counts[1][w], counts[0][w]
        if a + b >= least_docs:
            p, q = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
            told.append((abs(p - q) * abs(np.log(p / q)), w))
    chosen = [w for _, w in sorted(told, reverse=True)[:most_words]]
    ids = {w: i for i, w in enumerate(chosen)}

    # The chosen features of every distinct token, one after another.
    known = [[ids[f] for f in features(x) if f in ids] for x in number]
    n_of = np.array([len(x) for x in known], dtype=np.int64)
    code, first = np.array([i for x in known for i in x], dtype=np.int64), np.cumsum(n_of) - n_of
    sentence_of, word_of, doc_of = [], [], []
    total = 0
    plain = np.zeros(len(y))  # sentences of a document in which no chosen word stands: all have the bias as logit
    for d, found in enumerate(split):
        sentence = np.cumsum(found < 0)
        sentence, word = sentence[found >= 0], found[found >= 0]
        times = n_of[word]
        here = np.repeat(sentence, times)
        at = np.repeat(first[word] - np.cumsum(times) + times, times) + np.arange(len(here))
        known = np.unique(here)
        plain[d] = len(np.unique(sentence)) - len(known)
        sentence_of.append(np.searchsorted(known, here).astype(np.int64) + total)
        word_of.append(code[at])
        doc_of.append(np.full(len(known), d))
        total += len(known)
    s, w, doc = np.concatenate(sentence_of), np.concatenate(word_of), np.concatenate(doc_of)
    theta = np.zeros(len(chosen) + 1)
    theta[-1] = -5.0
    m = v = np.zeros_like(theta)
    weight = np.where(y == 1, min(4.0, n0 / n1) ** 0.5, 1.0)
    for k in range(1, rounds + 1):
        _, grad = loss_and_gradient(theta, s, w, doc, plain, y, weight)
        grad[:-1] += l2 * np.sign(theta[:-1]) * 0.1 + l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model({c: float(x) for c, x in zip(chosen, theta, strict=False) if abs(x) > 0.05}, float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, most: int = 12_000) -> Model:
    """From at most `most` labelled documents, by a hash of their ids, of those that are not held out."""
    chosen = common.sampled_labels(labels.where(common.crc32_mod(F.col("doc_id"), 5) != 0), "toxic", most)
    # Of rows that share an id, one text is taken.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    table = rows.select("doc_id", "label", "text").sort("doc_id").toArrow()
    return fit(table["text"].to_pylist(), table["label"].to_numpy())


SCORED = common.schema(doc_id=LONG, score=DOUBLE, offending=T.ArrayType(common.schema(start=INT, end=INT, score=DOUBLE)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted and the offending sentences as (start, end, score).

    A null, empty or wordless text scores 0. A null id is not held out. Rows are scored each for themselves, whole; an
    empty table gives no rows; only doc_id and text are read.
    """

    def scoring():
        def each(names: list, texts: list) -> Iterator[dict]:
            scores = [model.score(t) for t in texts]
            spans = [[{"start": a, "end": z, "score": p} for a, z, p in model.locate(t)] if s >= 0.5 else [] for t, s in zip(texts, scores, strict=True)]
            yield {"doc_id": names, "score": scores, "offending": spans}

        return each

    held = F.coalesce(common.crc32_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return common.over_texts(docs, scoring, SCORED).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
