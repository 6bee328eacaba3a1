"""Token counts under a unigram model, by dynamic programming shared in a trie.

The pieces are a public vocabulary's; a piece's score is the log probability of its rank under Zipf's law, so nothing is
trained. A pre-token is a word with a blank before it. Distinct pre-tokens of a batch are walked in order, which is a
depth-first walk of their trie: forward scores of a prefix are kept on a stack and computed once for all words below it,
and the count at a word's last node is stored for it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import tokens
from sparkloom.llm.common import words

#: Positions at which an equal score counts as a tie.
TIE = 1e-9
_LOADED: dict[str, "TrieCounter"] = {}


def zipf_scores(n: int) -> list[float]:
    """log(1 / ((rank + 1) * H)) for ranks 0 to n - 1, H making the probabilities sum to 1."""
    h = log(sum(1 / (r + 1) for r in range(n)))
    return [-log(r + 1) - h for r in range(n)]


class TrieCounter:
    """Counts tokens of pre-tokens; remembers at most `most` of them and forgets all beyond that, which changes no count."""

    def __init__(self, scores: dict[bytes, float], most: int = 500_000):
        self.most, self.known = most, {}
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.ends: dict[int, set[int]] = {}
        # Lengths of the pieces by their last two bytes: most positions are the end of few lengths.
        for p in scores:
            self.ends.setdefault(p[-1] | (p[-2] << 8 if len(p) > 1 else 1 << 16), set()).add(len(p))
        self.lengths = {k: sorted(v) for k, v in self.ends.items()}

    @classmethod
    def of_ranks(cls, path: str) -> "TrieCounter":
        """From a file of lines `base64 rank`."""
        if path not in _LOADED:
            with open(path, "rb") as f:
                pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
            _LOADED[path] = cls(dict(zip(pieces, zipf_scores(len(pieces)), strict=True)))
        return _LOADED[path]

    def learned(self, distinct: set[bytes]) -> dict[bytes, int]:
        """The counts of words, each with a blank before it; (best score, its tokens) of the first j bytes stand on a stack."""
        scores, lengths, out = self.scores, self.lengths, {}
        best, least, last = [0.0], [0], b""
        for word in sorted(distinct):
            w = b" " + word
            shared, most = 0, min(len(w), len(last))
            while shared < most and w[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], least[shared + 1 :]
            for j in range(shared + 1, len(w) + 1):
                top, n = -1e300, 0
                for key in ((w[j - 1] | 1 << 16, w[j - 1] | w[j - 2] << 8) if j > 1 else (w[0] | 1 << 16,)):
                    for size in lengths.get(key, ()):
                        if size > j:
                            break
                        s = scores.get(w[j - size : j])
                        if s is not None:
                            s += best[j - size]
                            tokens_ = least[j - size] + 1
                            if s > top + TIE or s > top - TIE and tokens_ < n:
                                top, n = s, tokens_
                if n == 0:  # a byte that is no piece is one token, less likely than any
                    top, n = best[j - 1] - 100.0, least[j - 1] + 1
                best.append(top)
                least.append(n)
            out[word] = least[len(w)]
            last = w
        return out

    def count(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        if len(self.known) > self.most:
            self.known = {}
        split = [words(t) for t in texts]
        known = self.known
        new = {w for ws in split for w in ws if w not in known}
        if new:
            known.update(self.learned(new))
        return [(len(ws), sum(map(known.__getitem__, ws))) for ws in split]


def token_counts(docs: DataFrame, ranks_path: str) -> DataFrame:
    """One row per document: doc_id, n_pretokens and n_tokens, of the whole text.

    Null, empty and blank texts have none of either. Rows count each for themselves; a null id stays null; an empty
    table gives no rows; further columns are ignored.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TrieCounter.of_ranks(ranks_path)
        for part in parts:
            names, texts = part["doc_id"].tolist(), part["text"].tolist()
            for a, z in tokens.in_slices(texts):
                found = counter.count(texts[a:z])
                yield pd.DataFrame({"doc_id": names[a:z], "n_pretokens": [n for n, _ in found], "n_tokens": [n for _, n in found]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_pretokens long, n_tokens long")

