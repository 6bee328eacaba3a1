"""Ranked full-text search: term counts, inverse document frequencies in log10, document norms; queries without idf or norm."""

from __future__ import annotations

import uuid
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.functions import vectors

#: Terms in at least one of so many documents, and no more terms than this, are weighed where their texts are read.
FREQUENT_SHARE, FREQUENT_TERMS = 5_000, 2**18


def frequencies(docs: DataFrame, key: str, content: str, stop: list[str] | None = None, stems: bool = False) -> DataFrame:
    """(key, term, tf)."""
    found = tx.preprocess(F.col(content), stop or [], stems) if stems else tx.terms(F.col(content), stop)
    return docs.select(F.col(key), F.explode(found).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf)."""
    return tf.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log10(F.lit(n_docs) / F.col("df")))


def weights(tf: DataFrame, n_docs: int) -> DataFrame:
    """(key, term, tf, w). Document counts are summed in parts before their shuffle and joined back, so a frequent term's postings are never gathered."""
    # A sum that needs tf, so that both sides have the same columns and Spark makes the frequencies once.
    df = tf.groupBy("term").agg(F.sum(F.least("tf", F.lit(1))).alias("_df"))
    return tf.join(df, "term").withColumn("w", (1 + F.log10("tf")) * F.log10(F.lit(n_docs) / F.col("_df"))).select(*tf.columns, "w")


def sums(weighted: DataFrame, key: str, query: dict[str, float]) -> DataFrame:
    """(key, _ww, _s): sums of squared weights and of products with the query's weights, null without a term of it."""
    return weighted.withColumn("_q", _of(query)).groupBy(key).agg(F.sum(F.col("w") * F.col("w")).alias("_ww"), F.sum(F.when(F.col("_q") != 0, F.col("_q") * F.col("w"))).alias("_s"))


def _of(query: dict[str, float]) -> Column:
    of = F.lit(0.0)
    for t, q in query.items():
        of = F.when(F.col("term") == t, F.lit(q)).otherwise(of)
    return of


def text_sums(docs: DataFrame, key: str, content: str, query: dict[str, float]) -> DataFrame:
    """`sums` over texts. Runs two jobs at once: one over the keys, one for the frequent terms.

    Where no key repeats, a text is counted where it is read. Its frequent terms are weighed there too, with document
    counts that each worker has, and leave one row; only rare terms go by shuffle, to be counted and weighed. So neither
    all postings nor those of a frequent term are gathered or held. Which terms are frequent decides the way, not the sums.
    """
    docs = docs.select(key, content)
    n_docs, most = docs.groupBy(key).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.max("count")).head()
    if most is None or most > 1:
        return sums(weights(frequencies(docs, key, content), n_docs), key, query)
    found = tx.terms(F.col(content))
    df = docs.select(F.explode(F.array_distinct(found)).alias("term")).groupBy("term").count()
    frequent = df.where(F.col("count") >= max(2, n_docs / FREQUENT_SHARE)).limit(FREQUENT_TERMS).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((frequent["term"].combine_chunks(), np.log10(n_docs / frequent["count"].to_numpy()), query))

    @F.arrow_udf("array<struct<term string, tf long, ww double, s double>>")
    def run(batch: pa.Array) -> pa.Array:
        return weighed(batch, *shared.value)

    # A sum of frequent terms has a name that no term has, and its key in it, so that these rows are dealt out evenly.
    rows = docs.select(key, F.inline(run(found))).withColumn("term", F.coalesce("term", F.concat(F.lit(" "), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    # A rare term's rows are few, so a window counts them without a second reading for a join.
    df = F.count("*").over(Window.partitionBy("term"))
    w, q = (1 + F.log10("tf")) * F.log10(F.lit(n_docs) / F.col("_df")), _of(query)
    rare = rows.withColumn("_df", df).select(key, F.coalesce("ww", w * w).alias("_ww"), F.when(F.col("tf").isNull(), F.col("s")).when(q != 0, q * w).alias("_s"))
    return rare.groupBy(key).agg(F.sum("_ww").alias("_ww"), F.sum("_s").alias("_s"))


def weighed(found: pa.Array, frequent: pa.Array, idf: np.ndarray, query: dict[str, float]) -> pa.Array:
    """Of each list of terms: (term, tf) of those that are not frequent, and one row of sums over those that are, if there are any."""
    words, lists, word, tf = tx.counted(found)
    at = pc.fill_null(pc.index_in(words, frequent), -1).to_numpy(zero_copy_only=False)[word]
    known = at >= 0
    n, w = len(found), (1 + np.log10(tf[known])) * idf[at[known]]
    asked = pc.index_in(words, pa.array(list(query), words.type))
    q = np.append(np.array(list(query.values()), float), 0.0)[pc.fill_null(asked, -1).to_numpy(zero_copy_only=False)][word][known]
    ww, s = np.bincount(lists[known], w * w, n), np.bincount(lists[known], q * w, n)
    some = np.flatnonzero(np.bincount(lists[known], minlength=n))
    hit = np.bincount(lists[known], q != 0, n) > 0
    rare = np.flatnonzero(~known)
    owner = np.concatenate([lists[rare], some])
    order = np.argsort(owner, kind="stable")
    blank, none = pa.nulls(len(some)), pa.nulls(len(rare), pa.float64())
    columns = (
        pa.concat_arrays([words.take(pa.array(word[rare])), blank.cast(words.type)]),
        pa.concat_arrays([pa.array(tf[rare], pa.int64()), blank.cast(pa.int64())]),
        pa.concat_arrays([none, pa.array(ww[some], pa.float64())]),
        pa.concat_arrays([none, pa.array(s[some], pa.float64(), mask=~hit[some])]),
    )
    taken = [c.take(pa.array(order)) for c in columns]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(taken, ["term", "tf", "ww", "s"]))


def norms(summed: DataFrame, key: str) -> DataFrame:
    return summed.select(key, F.sqrt("_ww").alias("norm"))


def query_weights(terms: list[str]) -> dict[str, float]:
    return {t: 1 + log10(n) for t, n in Counter(terms).items()}


def search(docs: DataFrame, key: str, content: str, terms: list[str], k: int = 10) -> DataFrame:
    """(key, score) of the k best, one pass: norms and products are summed in one grouping. No rows without a known term."""
    query = query_weights(terms)
    if not query:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    norm = F.when(F.col("_ww") == 0, 1.0).otherwise(F.sqrt("_ww"))
    return _best(text_sums(docs, key, content, query).where("_s is not null").select(key, (F.col("_s") / norm).alias("score")), key, k)


def _best(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The k of most score, by exact values; only the result is rounded."""
    return scored.orderBy(F.round("score", vectors.EXACT).desc(), key).limit(k).withColumn("score", F.round("score", 6))


def similarity_percent(score) -> F.Column:
    return F.round(score * 100, 2)


class TextIndex:
    """A collection's index, its postings and norms kept as Parquet once built, each build in a folder of its own.

    So a search that is already planned keeps the files that it reads; `versions` are the builds of this object.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", content: str = "text", stems: bool = True):
        self.spark, self.root, self.key, self.content, self.stems = spark, path, key, content, stems
        self.path, self.versions = path, 0

    def build(self, docs: DataFrame, n_docs: int | None = None) -> None:
        """Postings clustered by term, so that a search reads the files of its terms only."""
        self.versions += 1
        self.path = f"{self.root}/{uuid.uuid4().hex}"
        tf = frequencies(docs, self.key, self.content, tx.stopwords(), self.stems)
        weighted = weights(tf, docs.count() if n_docs is None else n_docs)
        weighted.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{self.path}/postings")
        norms(sums(self.postings(), self.key, {}), self.key).write.parquet(f"{self.path}/norms")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def query_terms(self, text: str) -> list[str]:
        row = self.spark.range(1).select(tx.preprocess(F.lit(text), None, self.stems).alias("t")).head()
        return list(row["t"])

    def search(self, text: str, k: int = 10) -> DataFrame:
        """(key, score): postings of the query's terms, joined with norms; a missing or zero norm counts as 1."""
        query = query_weights(self.query_terms(text))
        if not query:
            return self.postings().select(self.key, F.lit(0.0).alias("score")).limit(0)
        of = F.create_map(*[F.lit(x) for kv in query.items() for x in kv])
        hits = self.postings().where(F.col("term").isin(list(query))).groupBy(self.key).agg(F.sum(F.element_at(of, F.col("term")) * F.col("w")).alias("_s"))
        scored = hits.join(self.spark.read.parquet(f"{self.path}/norms"), self.key, "left")
        norm = F.when(F.coalesce("norm", F.lit(0.0)) == 0, 1.0).otherwise(F.col("norm"))
        return _best(scored.select(self.key, (F.col("_s") / norm).alias("score")), self.key, k)

    def stats(self) -> dict:
        """Documents with a norm, and distinct terms."""
        return {"doc_count": self.spark.read.parquet(f"{self.path}/norms").count(), "vocab_size": self.postings().select("term").distinct().count()}
