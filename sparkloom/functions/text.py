"""Text to terms: lower case, letters and digits only, stop words and short words out, optionally stems."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.stemmer import stem

#: Fixed value: what is neither a term's character nor white space.
NOT_TERM = r"[^a-záéíóúñ0-9\s]"
#: A worker remembers the stems of so many words, none of more characters; the others are stemmed again.
REMEMBERED, REMEMBERED_LENGTH = 2**17, 64


def stopwords() -> list[str]:
    """The 313 Spanish stop words, with the two that Spark's list misspells put right."""
    fixed = {"vosostros": "vosotros", "vosostras": "vosotras"}
    return sorted({fixed.get(w, w) for w in StopWordsRemover.loadDefaultStopWords("spanish")})


def raw_terms(text: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?U)" + NOT_TERM, ""), r"(?U)\s+")


def terms(text: Column, stop: list[str] | None = None) -> Column:
    """The array of a text's terms without stop words and words of one character; none for null."""
    found = F.filter(raw_terms(text), lambda w: F.length(w) > 1)
    return F.filter(found, lambda w: ~w.isin(stop)) if stop else found


@lru_cache(REMEMBERED)
def _remembered(word: str) -> str:
    return stem(word)


def stem_lists(found: pa.Array) -> pa.Array:
    """Stems of a batch of lists; each distinct word of a batch is stemmed once at most, those met before in this worker mostly not at all."""
    words = found.flatten().dictionary_encode()
    known = pa.array([w if w is None else _remembered(w) if len(w) <= REMEMBERED_LENGTH else stem(w) for w in words.dictionary.to_pylist()], words.dictionary.type)
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(found), 0).cast(pa.int32()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, known.take(words.indices), mask=found.is_null() if found.null_count else None)


def counted(found: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of lists of terms: its distinct terms, and by list and term the list's number, the term's, and how often it occurs."""
    words = found.flatten().dictionary_encode()
    lists = np.repeat(np.arange(len(found)), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
    n = max(len(words.dictionary), 1)
    pairs, tf = np.unique(lists * n + words.indices.to_numpy(), return_counts=True)
    return words.dictionary, pairs // n, pairs % n, tf


def stemmed(found: Column) -> Column:
    """Stems of an array of terms."""

    @F.arrow_udf("array<string>")
    def run(batch: pa.Array) -> pa.Array:
        return stem_lists(batch)

    return run(found)


def preprocess(text: Column, stop: list[str] | None = None, stems: bool = True) -> Column:
    found = terms(text, stopwords() if stop is None else stop)
    return stemmed(found) if stems else found
