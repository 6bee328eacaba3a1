"""Language of words in code-switched text by a linear-chain conditional random field, and of documents from its words.

A word's features are hashed affixes and n-grams (with marks at both ends) and whether a lexicon of frequent words has
it; transitions between the languages of neighbours are learned with them. Chains are whole sentences, however long.
Forward-backward runs over all chains of a batch at once, one position at a time; a long chain is cut into blocks that
products of matrices join again, exactly. Features are summed for a batch's distinct words only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import common, tokens
from sparkloom.llm.common import DOUBLE, LONG, STRING

BUCKETS = 1 << 16
#: Words of a block of a chain.
BLOCK = 64
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_BASE = np.uint64(0x100000001B3)
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: the lower case (where that is one character), whether it is a letter, and powers for word hashes."""
    if not _TABLES:
        lower, letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, dtype=bool)
        for i in range(0x30000):
            c = chr(i)
            if c.isalpha():
                letter[i] = True
                if len(low := c.lower()) == 1:
                    lower[i] = ord(low)
        letter[0x30000:0x31350] = True  # ideographs
        powers = np.ones(256, dtype=np.uint64)
        for i in range(1, 256):
            powers[i:] *= _BASE
        _TABLES.update(lower=lower, letter=letter, powers=powers)
    return _TABLES["lower"], _TABLES["letter"], _TABLES["powers"]


class Words:
    """All words of some texts: where each begins in the joined code points, its length, its text and its sentence."""

    def __init__(self, texts: list[str | None]):
        lower, letter, powers = _tables()
        joined = "\n".join(t or "" for t in texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letter[points]
        edge = np.diff(is_letter.view(np.int8), prepend=0)
        self.points = lower[points]
        self.start = np.flatnonzero(edge == 1)
        self.length = np.flatnonzero(edge == -1) - self.start
        bounds = np.cumsum([len(t or "") + 1 for t in texts])
        self.text = np.searchsorted(bounds, self.start, "right")
        # A sentence ends at a line end, or at one of . ! ? ; texts are joined by line ends.
        ends = np.flatnonzero((points == 10) | (points == 46) | (points == 33) | (points == 63))
        self.sentence = np.searchsorted(ends, self.start, "right")
        if len(self.start):
            inside = np.arange(len(points)) - np.repeat(np.append(0, self.start), np.diff(np.concatenate([[0], self.start, [len(points)]])))
            terms = np.where(is_letter, (self.points.astype(np.uint64) + np.uint64(1)) * powers[inside & 255], np.uint64(0))
            self.key = np.add.reduceat(terms, self.start) * _MULT[0] ^ self.length.astype(np.uint64)
        else:
            self.key = np.empty(0, dtype=np.uint64)

    def features(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, bucket) of every feature of the words `at`: n-grams of 1 to 4 characters with end marks, so affixes too."""
        start, length = self.start[at], self.length[at] + 2
        word = np.repeat(np.arange(len(at)), length)
        inside = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
        last = np.repeat(length, length) - 1
        chars = self.points[np.clip(np.repeat(start, length) + inside - 1, 0, len(self.points) - 1)].astype(np.uint64)
        chars[inside == 0], chars[inside == last] = 1, 2
        words, buckets, h = [], [], np.zeros(len(word), dtype=np.uint64)
        for n in range(1, 5):
            tail = np.zeros(len(word), dtype=np.uint64)
            tail[n - 1 :] = chars[: len(chars) - n + 1] if n > 1 else chars
            h = h * _MULT[1] + tail * _MULT[0] + np.uint64(n)
            ok = inside >= n - 1
            words.append(word[ok])
            buckets.append(((h[ok] ^ (h[ok] >> np.uint64(29))) * _MULT[2] >> np.uint64(48)).astype(np.int64))
        return np.concatenate(words), np.concatenate(buckets)


class Model:
    """Languages, feature weights, lexicon weights, transitions and begins of the field."""

    def __init__(self, langs: list[str], weights: np.ndarray, lexicon: np.ndarray, lexicon_weights: np.ndarray, transitions: np.ndarray):
        self.langs, self.weights, self.lexicon, self.lexicon_weights, self.transitions = langs, weights, lexicon, lexicon_weights, transitions

    def emissions(self, w: Words, at: np.ndarray) -> np.ndarray:
        word, bucket = w.features(at)
        order = np.bincount(word, minlength=len(at))
        out = np.column_stack([np.bincount(word, self.weights[bucket, k], len(at)) for k in range(len(self.langs))]) / np.sqrt(np.maximum(order, 1))[:, None]
        if len(self.lexicon):
            i = np.minimum(np.searchsorted(self.lexicon, w.key[at]), len(self.lexicon) - 1)
            known = self.lexicon[i] == w.key[at]
            out[known] += self.lexicon_weights[i[known]]
        return out

    def marginals(self, w: Words) -> np.ndarray:
        """P(language) of every word, by forward-backward over sentences."""
        if not len(w.start):
            return np.empty((0, len(self.langs)))
        _, first, inverse = np.unique(w.key, return_index=True, return_inverse=True)
        return forward_backward(self.emissions(w, first)[inverse], w.sentence, self.transitions)[0]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, mean P over the words) of each text; und and 0 without a letter."""
        w = Words(texts)
        p = self.marginals(w)
        sums = np.column_stack([np.bincount(w.text, p[:, k], len(texts)) for k in range(len(self.langs))]) if self.langs else np.zeros((len(texts), 0))
        n = np.bincount(w.text, minlength=len(texts))
        return [(self.langs[int(s.argmax())], float(min(1.0, s.max() / k))) if k and self.langs else ("und", 0.0) for s, k in zip(sums, n, strict=True)]

    def label_words(self, text: str | None) -> list[tuple[str, str, float]]:
        """(word, language, P) of each word of a text."""
        w = Words([text])
        p = self.marginals(w)
        return [(text[s : s + n], self.langs[int(q.argmax())], float(q.max())) for s, n, q in zip(w.start, w.length, p, strict=True)]


def _transfers(e: np.ndarray, m: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each block the product of (transition, emission) over its words, up to a factor; blocks of falling length."""
    out = np.tile(np.eye(len(m)), (len(begin), 1, 1))
    for t in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -t, "left"))
        x = (out[:n] @ m) * e[begin[:n] + t][:, None, :]
        out[:n] = x / x.sum(axis=(1, 2), keepdims=True)
    return out


def forward_backward(emission: np.ndarray, chain: np.ndarray, transitions: np.ndarray, want_pairs: bool = False, block: int = BLOCK):
    """Marginals of each word (rows in order; equal `chain` is one chain), the log partition sum, and summed pair marginals.

    A chain of more than `block` words is worked on in blocks: what enters and leaves each is found by the products of
    the blocks' matrices, so the result is that of the whole chain.
    """
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    m = np.exp(transitions - transitions.max(initial=0))
    first = np.flatnonzero(np.diff(chain, prepend=chain[0] - 1))
    size = np.diff(np.append(first, len(chain)))
    blocks = -(-size // block)
    of = np.repeat(np.arange(len(first)), blocks)  # the chain of each block
    number = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[of] + block * number
    length = np.minimum(block, first[of] + size[of] - begin)
    order = np.argsort(-length, kind="stable")
    begin, length, of, number = begin[order], length[order], of[order], number[order]
    enters, leaves = number > 0, number < blocks[of] - 1
    active = np.searchsorted(-length, -np.arange(length[0]), "left")  # blocks longer than t
    k = len(m)
    enter, leave = np.zeros((len(of), k)), np.ones((len(of), k))
    if leaves.any():
        at = np.full((int(blocks.max()), len(first)), -1)  # the place of a chain's n-th block
        at[number, of] = np.arange(len(of))
        longer = np.flatnonzero(enters | leaves)
        product = np.zeros((len(of), k, k))
        product[longer] = _transfers(e, m, begin[longer], length[longer])
        # The first word has no transition into it.
        start = np.flatnonzero(leaves & ~enters)
        head = e[begin[start]]
        for t in range(1, block):
            head = (head @ m) * e[begin[start] + t]
            head /= head.sum(axis=1, keepdims=True)
        now = np.zeros((len(first), k))
        now[of[start]] = head / head.sum(axis=1, keepdims=True)
        for n in range(1, len(at)):
            x = at[n][at[n] >= 0]
            enter[x] = now[of[x]]
            y = (now[of[x]][:, None, :] @ product[x])[:, 0]
            now[of[x]] = y / y.sum(axis=1, keepdims=True)
        now = np.ones((len(first), k))
        for n in range(len(at) - 1, 0, -1):
            x = at[n][at[n] >= 0]
            y = (product[x] @ now[of[x]][:, :, None])[:, :, 0]
            now[of[x]] = y / y.sum(axis=1, keepdims=True)
            leave[at[n - 1][at[n] >= 0]] = now[of[x]]
    alpha, scale = np.empty_like(e), np.empty(len(e))
    for t in range(length[0]):
        x = begin[: active[t]] + t
        if t == 0:
            a = np.where(enters[:, None], enter @ m, 1.0) * e[x]
        else:
            a = (alpha[x - 1] @ m) * e[x]
        scale[x] = s = a.sum(axis=1)
        alpha[x] = a / s[:, None]
    last = begin + length - 1
    beta = np.ones_like(e)
    beta[last] = leave / (alpha[last] * leave).sum(axis=1, keepdims=True)
    for t in range(length[0] - 2, -1, -1):
        x = begin[: active[t + 1]] + t
        beta[x] = ((e[x + 1] * beta[x + 1]) @ m.T) / scale[x + 1][:, None]
    p = alpha * beta
    if not want_pairs:
        return p, None, None
    log_z = np.log(scale).sum() + emission.max(axis=1).sum() + transitions.max(initial=0) * (len(chain) - len(first))
    inner = np.flatnonzero(np.diff(chain) == 0)
    right = e[inner + 1] * beta[inner + 1] / scale[inner + 1][:, None]
    return p, log_z, (alpha[inner].T @ right) * m


def fit(texts: list[str], langs: list[str], rounds: int = 30, lexicon_size: int = 4000, switched: float = 0.3, seed: int = 11) -> Model:
    """Learns from texts of one language each. Of their sentences a share is joined to one of another text, so that switches are seen."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.empty(0, dtype=np.uint64), np.zeros((0, 0)), np.zeros((0, 0)))
    w = Words(texts)
    k = len(names)
    if not len(w.start):
        return Model(names, np.zeros((BUCKETS, k)), np.empty(0, dtype=np.uint64), np.zeros((0, k)), np.zeros((k, k)))
    rng = np.random.default_rng(seed)
    label = np.array([names.index(x) for x in langs])[w.text]
    # Sentences in a random order; each is joined to the one before with probability `switched`.
    begin = np.flatnonzero(np.diff(w.sentence, prepend=w.sentence[0] - 1))
    length = np.diff(np.append(begin, len(w.sentence)))
    shuffled = rng.permutation(len(begin))
    new_length = length[shuffled]
    offset = np.cumsum(new_length) - new_length
    order = np.repeat(begin[shuffled] - offset, new_length) + np.arange(len(w.start))
    chain = np.repeat(np.cumsum(rng.random(len(begin)) >= switched), new_length)
    label = label[order]
    keys, first, inverse, count = np.unique(w.key, return_index=True, return_inverse=True, return_counts=True)
    ids = inverse[order]
    word, bucket = w.features(first)
    norm = 1 / np.sqrt(np.maximum(np.bincount(word, minlength=len(first)), 1))
    used, column = np.unique(bucket, return_inverse=True)
    frequent = np.sort(np.argsort(-count, kind="stable")[:lexicon_size])
    theta = np.zeros((len(used), k))
    lex = np.zeros((len(frequent), k))
    trans = np.zeros((k, k))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (theta, lex, trans)]
    observed = np.zeros((len(first), k))
    np.add.at(observed, (ids, label), 1)
    pairs = np.zeros((k, k))
    inner = np.flatnonzero(np.diff(chain) == 0)
    np.add.at(pairs, (label[inner], label[inner + 1]), 1)
    total = len(ids)
    for r in range(1, rounds + 1):
        emission = np.column_stack([np.bincount(word, theta[column, j], len(first)) for j in range(k)]) * norm[:, None]
        emission[frequent] += lex
        p, _, expected = forward_backward(emission[ids], chain, trans, True)
        gap = np.column_stack([np.bincount(ids, p[:, j], len(first)) for j in range(k)]) - observed
        scaled = gap * norm[:, None]
        grads = (
            np.column_stack([np.bincount(column, scaled[word, j], len(used)) for j in range(k)]) / total + 1e-6 * theta,
            gap[frequent] / total + 1e-6 * lex,
            (expected - pairs) / total + 1e-4 * trans,
        )
        for x, g, s in zip((theta, lex, trans), grads, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            x -= 0.2 * (s[0] / (1 - 0.9**r)) / (np.sqrt(s[1] / (1 - 0.99**r)) + 1e-9)
    weights = np.zeros((BUCKETS, k))
    weights[used] = theta
    return Model(names, weights, keys[frequent], lex, trans)


def train(docs: DataFrame, most: int = 800) -> Model:
    """From at most `most` documents that are not held out and have a language, by a hash of their ids; whole texts.

    Ids are sampled first, without texts; then the texts of those ids alone are fetched. Of rows that share an id, the
    least text is taken.
    """
    known = docs.where(F.col("lang").isNotNull() & (common.crc32_mod(F.col("doc_id"), 3) != 1))
    chosen = common.sampled(known.select("doc_id"), most, lambda rows: rows.distinct())
    rows = known.where("text is not null").select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")  # at most `most` ids
    table = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("row")).select("doc_id", "row.text", "row.lang").toPandas().sort_values("doc_id", ignore_index=True)
    return fit(table["text"].tolist(), table["lang"].tolist())


LABELLED = common.schema(doc_id=LONG, lang_pred=STRING, score=DOUBLE)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred and score.

    A null text and one without a letter are `und` with score 0. A null id is not held out. Rows are judged each for
    themselves, whole; an empty table gives no rows; only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and the lexicon

    def labelling():
        def each(names: list, texts: list) -> Iterator[dict]:
            for a, z in tokens.in_slices(texts, 1_000_000):
                found = shared.value.predict(texts[a:z])
                yield {"doc_id": names[a:z], "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

        return each

    held = F.coalesce(common.crc32_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return common.over_texts(docs, labelling, LABELLED).select("doc_id", held.alias("held_out"), "lang_pred", "score")
