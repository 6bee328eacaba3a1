"""Bags of quantised descriptors: codebooks, histograms, two TF-IDF weightings, exact and inverted-index nearest neighbours.

kind is "image" or "audio": they differ in how K is chosen, in idf, in the threshold of a posting and in which norms divide.
"""

from __future__ import annotations

from math import log10, sqrt

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import vectors

#: The least weight of a posting, and how many items a first codebook needs.
LEAST_WEIGHT = {"image": 1e-7, "audio": 1e-6}
FIRST_BUILD = {"image": 10, "audio": 5}


def codebook_size(kind: str, descriptors: int, items: int) -> int:
    """The rule for K."""
    if kind == "audio":
        least, most = max(32, 2 * items), min(512, descriptors // 50)
        return max(least, min(int(sqrt(descriptors / 20)), most))
    if items < 100:
        k, low, high = descriptors // 80, 500, 5000
    elif items < 10_000:
        k, low, high = int(sqrt(descriptors / 2)), 1000, 10_000
    else:
        k, low, high = int(1000 * log10(items)), 5000, 50_000
    return (min(max(k, low), high) + 50) // 100 * 100


def train_codebook(descriptors: DataFrame, column: str, k: int, seed: int = 42) -> KMeansModel:
    """Lloyd's algorithm from k-means|| on the whole set; K is at most the number of descriptors."""
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="word", maxIter=20).fit(descriptors.select(array_to_vector(F.col(column).cast("array<double>")).alias("_v")))


def assign_with(model: KMeansModel, descriptors: DataFrame, column: str) -> DataFrame:
    return model.transform(descriptors.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))).drop("_v")


def assign(descriptors: DataFrame, column: str, centroids: list[tuple[int, list[float]]]) -> DataFrame:
    """Adds word, the nearest of given centroids (ties: the least word), without a join: a codebook's size is bounded by its rule."""
    words, at = zip(*sorted(centroids), strict=True)
    words, at = np.array(words, dtype=np.int64), np.array(at, dtype=float)
    rows = max(1, 2_000_000 // at.size)

    @F.pandas_udf("long")
    def nearest(vectors_: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors_), dtype="Int64")
        known = np.flatnonzero(vectors_.notna())
        for i in range(0, len(known), rows):
            part = known[i : i + rows]
            x = np.stack(vectors_.iloc[part].tolist()).astype(float)
            d = ((x[:, None, :] - at[None]) ** 2).sum(axis=2)
            out.iloc[part] = words[d.round(9).argmin(axis=1)]
        return out

    return descriptors.withColumn("word", nearest(F.col(column)))


def histogram(assigned: DataFrame, item: str) -> DataFrame:
    """(item, word, cnt), without zeros."""
    return assigned.groupBy(item, "word").agg(F.count("*").alias("cnt"))


def idf(hist: DataFrame, kind: str, n_items: int) -> DataFrame:
    """(word, idf)."""
    df = F.col("df")
    formula = F.log((n_items + 1) / (df + 1)) + 1 if kind == "image" else F.log(F.lit(n_items) / (df + 1)) + 1
    return hist.groupBy("word").agg(F.count("*").alias("df")).select("word", formula.alias("idf"))


def tfidf(hist: DataFrame, item: str, kind: str, n_items: int, alpha: float | None = None) -> DataFrame:
    """(item, word, w): ln(1 + count), or for images count ** alpha, times idf, each item scaled to length 1."""
    tf = F.log1p("cnt") if alpha is None else F.signum("cnt") * F.pow(F.abs(F.col("cnt")), F.lit(alpha))
    raw = hist.join(idf(hist, kind, n_items), "word").withColumn("_w", tf * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(item)))
    least = vectors.TINY if kind == "image" else 0.0
    return raw.withColumn("_n", norm).select(item, "word", F.when(F.col("_n") > least, F.col("_w") / F.col("_n")).otherwise(F.col("_w")).alias("w"))


def postings(weighted: DataFrame, kind: str) -> DataFrame:
    return weighted.where(F.col("w") > LEAST_WEIGHT[kind])


def inverted_search(weighted: DataFrame, item: str, query: DataFrame, kind: str, k: int) -> DataFrame:
    """(item, sim) of items that share a word with `query` (word, qw; bounded by the codebook). Images are divided by both norms, audio by the query's."""
    q = query.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    hits = postings(weighted, kind).join(query, "word").groupBy(item).agg(F.sum(F.col("w") * F.col("qw")).alias("_s"))
    if kind == "image":
        norm = weighted.groupBy(item).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
        hits = hits.join(norm, item).where(F.col("_n") >= vectors.TINY)
    else:
        hits = hits.withColumn("_n", F.lit(1.0))
    scored = hits.crossJoin(F.broadcast(q)).where("qn > 0")  # q is one row
    return _best(scored.select(item, (F.col("_s") / (F.col("_n") * F.col("qn"))).alias("sim")), item, k)


def _best(scored: DataFrame, key: str, k: int, least: float | None = None) -> DataFrame:
    """The k of most sim, by exact values; only the result is rounded."""
    exact = F.round("sim", vectors.EXACT)
    found = scored.orderBy(exact.desc(), key).limit(k)
    return (found if least is None else found.where(exact >= least)).withColumn("sim", F.round("sim", 6))


def exact_search(items: DataFrame, key: str, column: str, query: list[float], k: int, kind: str = "image", least: float | None = None) -> DataFrame:
    """(key, sim) of the k nearest by cosine, of sim `least` or more. A query of zeros finds nothing among images, and everything at 0 among audio, whose vectors count as unit ones.

    A query of another dimension than a vector is cut or padded with zeros to it.
    """
    length = sqrt(sum(x * x for x in query))
    same = F.size(column) == len(query)
    if kind == "audio":
        unit = vectors.literal([x / (length or 1.0) for x in query])
        cut = vectors.fitted(vectors.literal(query), F.size(column))
        sim = F.when(same, vectors.dot(F.col(column), unit)).otherwise(vectors.dot(F.col(column), cut) / F.greatest(vectors.norm(cut), F.lit(vectors.TINY)))
    elif length < vectors.TINY:
        return items.select(key, F.lit(0.0).alias("sim")).limit(0)
    else:
        own = F.greatest(vectors.norm(F.col(column)), F.lit(vectors.TINY))
        cut = vectors.fitted(vectors.literal(query), F.size(column))
        sim = F.when(same, vectors.dot(F.col(column), vectors.literal(query)) / (own * length)).otherwise(vectors.dot(F.col(column), cut) / (own * F.greatest(vectors.norm(cut), F.lit(vectors.TINY))))
    return _best(items.where(F.col(column).isNotNull()).select(key, sim.alias("sim")), key, k, least)


def threshold_search(items: DataFrame, key: str, column: str, query: list[float], threshold: float = 0.5, most: int = 100) -> DataFrame:
    return exact_search(items, key, column, query, most, least=threshold)


def idf_stats(idfs: DataFrame) -> DataFrame:
    """One row: terms, and the least, largest and mean idf."""
    return idfs.agg(F.count("*").alias("terms"), F.round(F.min("idf"), 6).alias("min_idf"), F.round(F.max("idf"), 6).alias("max_idf"), F.round(F.avg("idf"), 6).alias("mean_idf"))


def enrich(found: DataFrame, items: DataFrame, key: str, kind: str) -> DataFrame:
    """Search results with the items' columns: images without any keep their row; audio rounds sim to 4 and leaves them out."""
    return found.join(items, key, "left") if kind == "image" else found.withColumn("sim", F.round("sim", 4)).join(items, key)


def posting_stats(hist: DataFrame) -> DataFrame:
    """One row: active_terms, avg_len, max_len, total."""
    return hist.groupBy("word").agg(F.count("*").alias("n")).agg(F.count("*").alias("active_terms"), F.round(F.avg("n"), 6).alias("avg_len"), F.max("n").alias("max_len"), F.sum("n").alias("total"))


def matrix(items: DataFrame, key: str, weighted: DataFrame, k: int) -> DataFrame:
    """(key, vector): dense, zeros for items without a word."""
    made = weighted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "w"))).alias("_m"))
    cell = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0)))
    return items.select(key).join(made, key, "left").select(key, cell.alias("vector"))


def zscores(elements: DataFrame, item: str) -> DataFrame:
    """Adds z to rows (item, dim, x): by the mean and population deviation of the item's dimension."""
    by = Window.partitionBy(item, "dim")
    return elements.withColumn("z", (F.col("x") - F.avg("x").over(by)) / (F.stddev_pop("x").over(by) + 1e-8))


def mean_std(elements: DataFrame, item: str) -> DataFrame:
    return elements.groupBy(item, "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def must_rebuild(kind: str, items: int, items_at_last: int | None) -> bool:
    """First at enough items, then when their number has doubled."""
    return items >= FIRST_BUILD[kind] if not items_at_last else items >= 2 * items_at_last


class SimilarityEngine:
    """Items (item_id, name, ...) and their descriptors (item_id, desc_no, descriptor), weighted and searchable."""

    def __init__(self, spark: SparkSession, kind: str, path: str):
        self.spark, self.kind, self.path = spark, kind, path
        self.items: DataFrame | None = None
        self.descriptors: DataFrame | None = None
        self.model: KMeansModel | None = None
        self.weighted: DataFrame | None = None
        self.built_at, self.version = 0, 0

    def add(self, items: DataFrame, descriptors: DataFrame) -> bool:
        """Adds items; rebuilds when the rule says so, and says whether it did."""
        self.items = items if self.items is None else self.items.unionByName(items)
        self.descriptors = descriptors if self.descriptors is None else self.descriptors.unionByName(descriptors)
        self._save()
        if must_rebuild(self.kind, self.items.count(), self.built_at):
            self.rebuild()
            return True
        if self.model is not None:
            self._weigh()
        return False

    def _save(self) -> None:
        self.version += 1
        for name in ("items", "descriptors"):
            getattr(self, name).write.parquet(f"{self.path}/{name}/{self.version}")
            setattr(self, name, self.spark.read.parquet(f"{self.path}/{name}/{self.version}"))

    def rebuild(self, k: int | None = None) -> None:
        n, total = self.items.count(), self.descriptors.count()
        self.model = train_codebook(self.descriptors, "descriptor", min(k or codebook_size(self.kind, total, n), total))
        self.model.write().overwrite().save(f"{self.path}/codebook")
        self.built_at = n
        self._weigh()

    def _weigh(self) -> None:
        self.version += 1
        hist = histogram(assign_with(self.model, self.descriptors, "descriptor"), "item_id")
        tfidf(hist, "item_id", self.kind, self.items.count()).write.parquet(f"{self.path}/weights/{self.version}")
        self.weighted = self.spark.read.parquet(f"{self.path}/weights/{self.version}")

    def search(self, descriptors: DataFrame, k: int = 10) -> DataFrame:
        """Items with sim, by a query item's descriptors; ValueError before the first build."""
        if self.model is None:
            raise ValueError("there is no codebook yet")
        words = histogram(assign_with(self.model, descriptors.withColumn("item_id", F.lit(-1)), "descriptor"), "item_id").select("word", "cnt")
        hist = histogram(assign_with(self.model, self.descriptors, "descriptor"), "item_id")
        query = words.join(idf(hist, self.kind, self.items.count()), "word").select("word", (F.log1p("cnt") * F.col("idf")).alias("qw"))
        found = inverted_search(self.weighted, "item_id", query, self.kind, k)
        return enrich(found, self.items, "item_id", self.kind).orderBy(F.desc("sim"), "item_id")

    def stats(self) -> dict:
        out = {"kind": self.kind, "items": self.items.count() if self.items is not None else 0, "vocabulary": len(self.model.clusterCenters()) if self.model else 0}
        return out | (posting_stats(self.weighted).head().asDict() if self.weighted is not None else {})

    def clear(self) -> None:
        self.items = self.descriptors = self.model = self.weighted = None
        self.built_at = 0
