"""One query per operator over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.functions import vectors
from sparkloom.operators import similarity, spatial, structures, textindex
from sparkloom.sql.engine import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Parameters that the queries and their SQL share.
TERMS, CENTER, RADIUS, BEGIN, CENTROIDS = ["the", "shin", "shin", "queux", "onion"], [5000.0, 12.0], 900.0, [5000.0, 12.0], 8
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id"}


def query(oracle: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def sql(spark: SparkSession, sf_dir: str, name: str, text: str, structure: str | None = None) -> DataFrame:
    """Through the dialect, over a table that is there already."""
    engine = Engine(spark)
    engine.catalog.register(name, table(spark, sf_dir, name), KEYS[name], structure, structure)
    out = engine.execute_sql(text)
    if not out.success:
        raise ValueError(out.errors)
    return out.result


def _sql_query(name: str, source: str, text: str, oracle: str, structure: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sql(spark, sf_dir, source, text, structure)

    QUERIES[name], ORACLES[name] = run, oracle


_sql_query("scan_project", "customer", "SELECT c_custkey, c_name, c_acctbal FROM customer;", "SELECT c_custkey, c_name, c_acctbal FROM customer")
_sql_query("scan_heap", "nation", "SELECT * FROM nation;", "SELECT * FROM nation", "HEAP")
_sql_query("point_eq", "orders", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77;", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
_sql_query("hash_point", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 1001", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 1001", "HASH")
_sql_query("range_between", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 10 AND 200;", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 10 AND 200")
_sql_query("range_reversed", "lineitem", "SELECT l_orderkey FROM lineitem WHERE l_orderkey BETWEEN 200 AND 10;", "SELECT l_orderkey FROM lineitem WHERE l_orderkey BETWEEN 200 AND 10")
_sql_query("range_and_filter", "lineitem", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 10 AND 20 AND l_quantity > 5;", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 10 AND 20 AND l_quantity > 5")
_sql_query("in_list", "part", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 15, 33);", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 15, 33)")
_sql_query("in_two_values", "part", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 15);", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 15)")
_sql_query("comparisons", "part", "SELECT p_partkey, p_retailprice, p_size FROM part WHERE p_retailprice >= 900.5 AND p_size < 20 AND p_size <= 19 AND p_partkey > 7;", "SELECT p_partkey, p_retailprice, p_size FROM part WHERE p_retailprice >= 900.5 AND p_size < 20 AND p_size <= 19 AND p_partkey > 7")
_sql_query("mixed_left_assoc", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5 OR l_quantity > 40 AND l_discount >= 0.05;", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 5 OR l_quantity > 40) AND l_discount >= 0.05")
_sql_query("parentheses", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5 OR (l_quantity > 40 AND l_discount >= 0.05);", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5 OR (l_quantity > 40 AND l_discount >= 0.05)")
_sql_query("type_mismatch", "part", "SELECT p_partkey FROM part WHERE p_size = '5';", "SELECT p_partkey FROM part WHERE false")
_sql_query("string_range", "customer", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment BETWEEN 'B' AND 'G';", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment BETWEEN 'B' AND 'G'")
_sql_query("spatial_in", "embeddings", "SELECT vec_id FROM embeddings WHERE embedding IN ([0.0, 0.0], 0.1);", "SELECT vec_id FROM embeddings WHERE sqrt(pow(embedding[1]::DOUBLE, 2) + pow(embedding[2]::DOUBLE, 2)) <= 0.1")


@query("SELECT count(*) AS n FROM orders")
def table_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 10 AND 30")
def isam_range_swapped(spark, sf_dir):
    return structures.isam_range(table(spark, sf_dir, "lineitem"), "l_orderkey", 30, 10).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 900 ORDER BY o_orderkey")
def seq_range_ordered(spark, sf_dir):
    return structures.key_range(table(spark, sf_dir, "orders"), "o_orderkey", 100, 900).select("o_orderkey", "o_custkey")


@query(f"SELECT c_custkey FROM customer WHERE sqrt(pow(c_acctbal - {CENTER[0]}, 2) + pow(c_nationkey - {CENTER[1]}, 2)) <= {RADIUS}")
def rtree_range(spark, sf_dir):
    return spatial.range_search(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], CENTER, RADIUS).select("c_custkey")


@query(f"SELECT c_custkey, round(sqrt(pow(c_acctbal - {CENTER[0]}, 2) + pow(c_nationkey - {CENTER[1]}, 2)), 6) AS dist FROM customer ORDER BY dist, c_custkey LIMIT 10")
def rtree_knn(spark, sf_dir):
    return spatial.nearest(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], CENTER, 10, "c_custkey").select("c_custkey", "dist")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT coalesce(o_totalprice > 100000 AND o_orderstatus = 'F', false)")
def delete_survivors(spark, sf_dir):
    return structures.delete(table(spark, sf_dir, "orders"), (F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1")
def seq_unique_insert(spark, sf_dir):
    return structures.seq_insert(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 10 = 0")
def hash_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return structures.upsert(old, old.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 50")
def isam_base_delta(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return structures.base_and_delta(rows, rows.where("o_orderkey < 50"))


@query("SELECT ('0x' || right(md5(o_orderkey::VARCHAR), 1))::INT & 3 AS bucket, count(*) AS n FROM orders GROUP BY 1")
def hash_bucket_stats(spark, sf_dir):
    return structures.hash_directory(table(spark, sf_dir, "orders"), "o_orderkey")


_TF = r"""WITH tok AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-záéíóúñ0-9\s]', '', 'g'), '\s+')) term FROM documents),
tf AS (SELECT doc_id, term, count(*) tf FROM tok WHERE length(term) > 1 GROUP BY 1, 2)"""
_W = _TF + """, df AS (SELECT term, count(*) df FROM tf GROUP BY 1),
w AS (SELECT tf.doc_id, term, (1 + log10(tf)) * log10((SELECT count(*) FROM documents) / df) w FROM tf JOIN df USING (term))"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, cores = table(spark, sf_dir, "documents").select("doc_id", "text"), spark.sparkContext.defaultParallelism
    if len(docs.inputFiles()) < cores // 2 and docs.rdd.getNumPartitions() < cores:  # a table of few files only, so that all cores work
        docs = docs.repartition(cores)
    return docs


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textindex.frequencies(_texts(spark, sf_dir), "doc_id", "text")


@query(_TF + " SELECT doc_id, term, tf FROM tf")
def text_tf(spark, sf_dir):
    return _frequencies(spark, sf_dir)


@query(_TF + " SELECT term, count(*) AS df, round(log10((SELECT count(*) FROM documents) / count(*)), 6) AS idf FROM tf GROUP BY 1")
def text_df_idf(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return textindex.document_frequencies(_frequencies(spark, sf_dir), n).withColumn("idf", F.round("idf", 6))


@query(_W + " SELECT doc_id, round(sqrt(sum(w * w)), 6) AS norm FROM w GROUP BY 1")
def text_norms(spark, sf_dir):
    return textindex.norms(textindex.text_sums(_texts(spark, sf_dir), "doc_id", "text", {}), "doc_id").withColumn("norm", F.round("norm", 6))


@query(_TF + " SELECT DISTINCT term FROM tf")
def text_vocabulary(spark, sf_dir):
    return _frequencies(spark, sf_dir).select("term").distinct()


@query(_W + """, nm AS (SELECT doc_id, sqrt(sum(w * w)) norm FROM w GROUP BY 1), q(term, qtf) AS (VALUES ('the', 1), ('shin', 2), ('queux', 1), ('onion', 1)),
s AS (SELECT doc_id, round(sum((1 + log10(qtf)) * w) / CASE WHEN any_value(norm) = 0 THEN 1.0 ELSE any_value(norm) END, 6) score FROM w JOIN q USING (term) JOIN nm USING (doc_id) GROUP BY 1)
SELECT doc_id, score, round(score * 100, 2) AS percent FROM s ORDER BY score DESC, doc_id LIMIT 10""")
def text_search_topk(spark, sf_dir):
    found = textindex.search(_texts(spark, sf_dir), "doc_id", "text", TERMS)
    return found.withColumn("percent", textindex.similarity_percent(F.col("score")))


@query()
def text_stopwords(spark, sf_dir):
    """Terms without the 313 stop words; the list is Spark's own, so SQL has no copy of it."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(tx.terms(F.col("text"), tx.stopwords())).alias("n_terms"))


@query()
def text_stems(spark, sf_dir):
    found = F.array_distinct(tx.terms(F.col("text"), tx.stopwords()))  # a repeated term has the same stem
    return _texts(spark, sf_dir).select("doc_id", F.size(F.array_distinct(tx.stemmed(found))).alias("n_stems"))


def _vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).head()["embedding"]]


@query("WITH q AS (SELECT embedding q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS sim FROM embeddings, q ORDER BY sim DESC, vec_id LIMIT 10")
def vec_cosine_knn(spark, sf_dir):
    return similarity.exact_search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _vector(spark, sf_dir), 10)


@query("WITH q AS (SELECT embedding q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS sim FROM embeddings, q) SELECT * FROM s ORDER BY sim DESC, vec_id LIMIT 10")
def vec_dot_knn_audio(spark, sf_dir):
    return similarity.exact_search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _vector(spark, sf_dir), 10, "audio")


@query("WITH q AS (SELECT embedding q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS sim FROM embeddings, q) SELECT * FROM s WHERE sim >= 0.2 ORDER BY sim DESC, vec_id LIMIT 100")
def vec_cosine_threshold(spark, sf_dir):
    return similarity.threshold_search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _vector(spark, sf_dir), 0.2, 100)


def _hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.histogram(_assigned(spark, sf_dir), "label")


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    given = [(int(r["vec_id"]), [float(x) for x in r["embedding"]]) for r in rows.where(F.col("vec_id") < CENTROIDS).collect()]
    return similarity.assign(rows, "embedding", sorted(given)).withColumn("word", F.col("word").cast("long"))


_ASG = f"""WITH asg AS (SELECT e.vec_id, e.label, arg_min(c.vec_id, struct_pack(d := round(list_sum(list_transform(list_zip(e.embedding, c.embedding),
lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 9), w := c.vec_id)) word FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < {CENTROIDS}) c GROUP BY 1, 2),
h AS (SELECT label, word, count(*) cnt FROM asg GROUP BY 1, 2)"""


def _tfidf(kind: str) -> str:
    formula = "ln((n + 1) / (df + 1)) + 1" if kind == "image" else "ln(n / (df + 1)) + 1"
    return _ASG + f""", df AS (SELECT word, count(*) df, (SELECT count(DISTINCT label) FROM h)::DOUBLE n FROM h GROUP BY 1), i AS (SELECT word, {formula} idf FROM df),
r AS (SELECT label, word, ln(1 + cnt) * idf w FROM h JOIN i USING (word)), v AS (SELECT label, word, w / sqrt(sum(w * w) OVER (PARTITION BY label)) w FROM r)"""


def _items(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "embeddings").select("label").distinct().count()


@query(_ASG + " SELECT vec_id, word FROM asg")
def codebook_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select("vec_id", "word")


@query(_ASG + " SELECT label, word, cnt FROM h")
def bovw_histogram(spark, sf_dir):
    return _hist(spark, sf_dir)


@query(_tfidf("image") + " SELECT word, round(idf, 6) AS idf FROM i")
def idf_image(spark, sf_dir):
    return similarity.idf(_hist(spark, sf_dir), "image", _items(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query(_tfidf("audio") + " SELECT word, round(idf, 6) AS idf FROM i")
def idf_audio(spark, sf_dir):
    return similarity.idf(_hist(spark, sf_dir), "audio", _items(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query(_tfidf("image") + " SELECT label, word, round(w, 6) AS w FROM v")
def tfidf_vector(spark, sf_dir):
    return similarity.tfidf(_hist(spark, sf_dir), "label", "image", _items(spark, sf_dir)).withColumn("w", F.round("w", 6))


@query(_tfidf("audio") + " SELECT label, word, round(w, 6) AS w FROM v")
def tfidf_vector_audio(spark, sf_dir):
    return similarity.tfidf(_hist(spark, sf_dir), "label", "audio", _items(spark, sf_dir)).withColumn("w", F.round("w", 6))


def _taat(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    weighted = similarity.tfidf(_hist(spark, sf_dir), "label", kind, _items(spark, sf_dir))
    return similarity.inverted_search(weighted, "label", weighted.where("label = 0").select("word", F.col("w").alias("qw")), kind, 5)


_TAAT = """, q AS (SELECT word, w qw FROM v WHERE label = 0 AND w IS NOT NULL), dn AS (SELECT label, sqrt(sum(w * w)) dn FROM v GROUP BY 1)
SELECT label, round(sum(w * qw) / (any_value(dn) * (SELECT sqrt(sum(qw * qw)) FROM q)), 6) AS sim FROM v JOIN q USING (word) JOIN dn USING (label) WHERE w > 1e-7 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""


@query(_tfidf("image") + _TAAT)
def taat_search(spark, sf_dir):
    return _taat(spark, sf_dir, "image")


@query(_tfidf("audio") + """, q AS (SELECT word, w qw FROM v WHERE label = 0)
SELECT label, round(sum(w * qw) / (SELECT sqrt(sum(qw * qw)) FROM q), 6) AS sim FROM v JOIN q USING (word) WHERE w > 1e-6 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def taat_search_audio(spark, sf_dir):
    return _taat(spark, sf_dir, "audio")


@query("WITH t AS (" + _tfidf("image") + _TAAT + ") SELECT t.label, t.sim, n.n_name FROM t LEFT JOIN nation n ON n.n_nationkey = t.label")
def enrich_topk(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("label"), "n_name")
    return _taat(spark, sf_dir, "image").join(names, "label", "left").select("label", "sim", "n_name")


@query(_ASG + ", n AS (SELECT word, count(*) n FROM h GROUP BY 1) SELECT count(*) AS active_terms, round(avg(n), 6) AS avg_len, max(n) AS max_len, sum(n)::BIGINT AS total FROM n")
def posting_stats(spark, sf_dir):
    return similarity.posting_stats(_hist(spark, sf_dir))


@query(_ASG + " SELECT label, cnt FROM h WHERE word = 3")
def posting_list(spark, sf_dir):
    return _hist(spark, sf_dir).where("word = 3").select("label", "cnt")


def _elements(spark: SparkSession, sf_dir: str, value=None) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding") if value is None else value).alias("dim", "x")).select("vec_id", "label", F.col("dim").cast("long").alias("dim"), F.col("x").cast("double").alias("x"))


_EL = "WITH el AS (SELECT vec_id, label, (generate_subscripts(embedding, 1) - 1)::BIGINT dim, unnest(embedding)::DOUBLE x FROM embeddings)"


@query(_EL + " SELECT vec_id, dim, round(sqrt(abs(x) / greatest(sum(abs(x)) OVER (PARTITION BY vec_id), 1e-7)), 6) AS x FROM el")
def rootsift(spark, sf_dir):
    rooted = vectors.root_sift(F.transform("embedding", lambda x: F.abs(x)))
    return _elements(spark, sf_dir, rooted).select("vec_id", "dim", F.round("x", 6).alias("x"))


@query(_EL + " SELECT vec_id, dim, round((x - avg(x) OVER p) / (stddev_pop(x) OVER p + 1e-8), 5) AS z FROM el WINDOW p AS (PARTITION BY label, dim)")
def zscore(spark, sf_dir):
    return similarity.zscores(_elements(spark, sf_dir), "label").select("vec_id", "dim", F.round("z", 5).alias("z"))


@query(_EL + " SELECT label, dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM el GROUP BY 1, 2")
def mean_std_summary(spark, sf_dir):
    return similarity.mean_std(_elements(spark, sf_dir), "label").select("label", "dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query()
def kmeans_codebook(spark, sf_dir):
    """A trained codebook's use: centroids depend on the trainer, so only rows are compared."""
    rows = table(spark, sf_dir, "embeddings")
    model = similarity.train_codebook(rows, "embedding", 16)
    return similarity.histogram(similarity.assign_with(model, rows, "embedding"), "label")


@query("""WITH c(kind, descriptors, items) AS (VALUES ('image', 17000::BIGINT, 30::BIGINT), ('image', 500000, 1000), ('image', 10000000, 60000), ('audio', 12000, 30), ('audio', 200000, 100)),
r AS (SELECT *, CASE WHEN items < 100 THEN descriptors // 80 WHEN items < 10000 THEN floor(sqrt(descriptors / 2)) ELSE floor(1000 * log10(items)) END k,
  CASE WHEN items < 100 THEN 500 WHEN items < 10000 THEN 1000 ELSE 5000 END low, CASE WHEN items < 100 THEN 5000 WHEN items < 10000 THEN 10000 ELSE 50000 END high FROM c)
SELECT kind, descriptors, items, (CASE kind WHEN 'audio' THEN greatest(32, 2 * items, least(floor(sqrt(descriptors / 20)), 512, descriptors // 50)) ELSE floor((least(greatest(k, low), high) + 50) / 100) * 100 END)::INT AS k FROM r""")
def k_rules(spark, sf_dir):
    cases = [("image", 17_000, 30), ("image", 500_000, 1000), ("image", 10_000_000, 60_000), ("audio", 12_000, 30), ("audio", 200_000, 100)]
    return spark.createDataFrame([(k, d, n, similarity.codebook_size(k, d, n)) for k, d, n in cases], "kind string, descriptors long, items long, k int")


# Vectors and places in any number of dimensions.

#: How much of a vector a shortened query has, and a radius that some vectors are within.
SHORT, NEAR = 40, 1.25
_DISTANCE = "sqrt(list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))"


@query(f"WITH q AS (SELECT list_resize(embedding[1:{SHORT}]::DOUBLE[], 64, 0.0) q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS sim FROM embeddings, q ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], q), 12) DESC, vec_id LIMIT 10")
def vec_knn_padded(spark, sf_dir):
    """A query of fewer dimensions than the vectors."""
    return similarity.exact_search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _vector(spark, sf_dir)[:SHORT], 10)


@query(f"WITH q AS (SELECT embedding q FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id, {_DISTANCE} d FROM embeddings, q) SELECT vec_id, round(d, 6) AS dist FROM d ORDER BY round(d, 12), vec_id LIMIT 10")
def array_knn(spark, sf_dir):
    found = spatial.nearest_array(table(spark, sf_dir, "embeddings"), "embedding", _vector(spark, sf_dir), 10, "vec_id")
    return found.select("vec_id", F.round("dist", 6).alias("dist"))


@query(f"WITH q AS (SELECT embedding q FROM embeddings WHERE vec_id = 0) SELECT vec_id FROM embeddings, q WHERE {_DISTANCE} <= {NEAR}")
def array_range(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where(spatial.within_array(F.col("embedding"), _vector(spark, sf_dir), NEAR)).select("vec_id")


@query(_tfidf("image") + " SELECT count(*) AS terms, round(min(idf), 6) AS min_idf, round(max(idf), 6) AS max_idf, round(avg(idf), 6) AS mean_idf FROM i")
def idf_statistics(spark, sf_dir):
    return similarity.idf_stats(similarity.idf(_hist(spark, sf_dir), "image", _items(spark, sf_dir)))


@query(_tfidf("audio") + """, q AS (SELECT word, w qw FROM v WHERE label = 0), t AS (SELECT label, sum(w * qw) / (SELECT sqrt(sum(qw * qw)) FROM q) sim FROM v JOIN q USING (word) WHERE w > 1e-6 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
SELECT t.label, round(round(t.sim, 6), 4) AS sim, n.n_name FROM t JOIN nation n ON n.n_nationkey = t.label""")
def enrich_topk_audio(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("label"), "n_name")
    return similarity.enrich(_taat(spark, sf_dir, "audio"), names, "label", "audio").select("label", "sim", "n_name")


@query(_tfidf("image") + f", x AS (SELECT DISTINCT label FROM embeddings), d AS (SELECT unnest(range({CENTROIDS})) word) SELECT x.label, d.word::INT AS word, round(coalesce(v.w, 0), 6) AS w FROM x, d LEFT JOIN v ON v.label = x.label AND v.word = d.word")
def tfidf_matrix(spark, sf_dir):
    """Dense vectors, one row a cell here."""
    weighted = similarity.tfidf(_hist(spark, sf_dir), "label", "image", _items(spark, sf_dir)).withColumn("word", F.col("word").cast("int"))
    cells = similarity.matrix(table(spark, sf_dir, "embeddings").select("label").distinct(), "label", weighted, CENTROIDS)
    return cells.select("label", F.posexplode("vector").alias("word", "w")).select("label", "word", F.round("w", 6).alias("w"))


# Tables that the dialect has written in the layout of each structure.


def _written(spark: SparkSession, name: str, ddl: str, *parts: DataFrame) -> Engine:
    engine = Engine(spark)
    if not (out := engine.execute_sql(f"CREATE TABLE {name} ({ddl});")).success:
        raise ValueError(out.errors)
    for rows in parts:
        engine.catalog.append(name, rows)
    return engine


def _answer(engine: Engine, text: str) -> DataFrame:
    if not (out := engine.execute_sql(text)).success:
        raise ValueError(out.errors)
    return out.result


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("id"), F.col("o_totalprice").alias("price"))


def _structure_scan(name: str, index: str, oracle: str) -> None:
    """All rows of a table of this structure, after a second load of which some keys are there already."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _orders(spark, sf_dir)
        again = rows.where("id % 7 = 0").select("id", (F.col("price") + 1).alias("price")).union(rows.where("id % 7 = 1").select((-F.col("id")).alias("id"), "price"))
        return _answer(_written(spark, "t", f"id INT KEY INDEX {index}, price FLOAT", rows, again), "SELECT * FROM t;")

    QUERIES[name], ORACLES[name] = run, oracle


_ORDERS = "WITH o AS (SELECT o_orderkey::INT id, o_totalprice price FROM orders) "
_BOTH = _ORDERS + "SELECT * FROM o UNION ALL SELECT id, price + 1 FROM o WHERE id % 7 = 0 UNION ALL SELECT -id, price FROM o WHERE id % 7 = 1"
_structure_scan("btree_scan", "BTree", _BOTH)
_structure_scan("isam_scan", "ISAM", _BOTH)
_structure_scan("seq_insert_stored", "SEQ", _ORDERS + "SELECT * FROM o UNION ALL SELECT -id, price FROM o WHERE id % 7 = 1")
_structure_scan("hash_scan", "Hash", _ORDERS + "SELECT id, CASE WHEN id % 7 = 0 THEN price + 1 ELSE price END AS price FROM o UNION ALL SELECT -id, price FROM o WHERE id % 7 = 1")


@query("SELECT o_orderkey::INT AS id, o_totalprice AS price FROM orders WHERE o_orderkey = 1001")
def hash_point_stored(spark, sf_dir):
    """A point search that reads one bucket of a written table."""
    return _answer(_written(spark, "t", "id INT KEY INDEX Hash, price FLOAT", _orders(spark, sf_dir)), "SELECT * FROM t WHERE id = 1001;")


def _places(spark: SparkSession, sf_dir: str) -> Engine:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("id"), F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("place"))
    return _written(spark, "t", "id INT KEY, place ARRAY[FLOAT] INDEX RTree", rows)


@query("SELECT c_custkey::INT AS id FROM customer")
def rtree_scan(spark, sf_dir):
    return _answer(_places(spark, sf_dir), "SELECT id FROM t;")


@query("SELECT c_custkey::INT AS id, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM customer WHERE c_custkey = 42")
def rtree_id(spark, sf_dir):
    return _answer(_places(spark, sf_dir), "SELECT * FROM t WHERE id = 42;").select("id", F.col("place")[0].alias("x"), F.col("place")[1].alias("y"))


@query(f"SELECT c_custkey::INT AS id FROM customer WHERE sqrt(pow(c_acctbal - {CENTER[0]}, 2) + pow(c_nationkey - {CENTER[1]}, 2)) <= {RADIUS}")
def rtree_radius_stored(spark, sf_dir):
    return _answer(_places(spark, sf_dir), f"SELECT id FROM t WHERE place IN ([{CENTER[0]}, {CENTER[1]}], {RADIUS});")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 7")
def heap_search(spark, sf_dir):
    """A search by a column that is no key, over rows in no order."""
    return sql(spark, sf_dir, "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 7;", "HEAP")


@query("SELECT doc_id::INT AS id, text FROM documents WHERE doc_id % 5 <> 0 OR doc_id >= 100 UNION ALL SELECT doc_id::INT, 'changed' FROM documents WHERE doc_id % 5 = 0 AND doc_id < 100")
def bow_scan(spark, sf_dir):
    """Rows with a full-text index, of which some are loaded again."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("id"), "text")
    engine = _written(spark, "t", "id INT KEY, text VARCHAR[1000000] INDEX BOW", rows, rows.where("id % 5 = 0 AND id < 100").withColumn("text", F.lit("changed")))
    return _answer(engine, "SELECT * FROM t;")


@query("SELECT count(*)::INT AS n, 1000 AS first, 'moved' AS changed FROM nation")
def position_update(spark, sf_dir):
    """Reading and overwriting a row by its position."""
    engine = _written(spark, "t", "id INT KEY INDEX ISAM, name VARCHAR[50]", table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    engine.catalog.update_at("t", 3, [1000, "moved"])
    here = engine.catalog.read_at("t", 3)
    return engine.catalog.df("t").agg(F.count("*").cast("int").alias("n")).crossJoin(here.select(F.col("id").alias("first"), F.col("name").alias("changed")))  # one row each


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT 99, 'NOWHERE'")
def ddl_roundtrip(spark, sf_dir):
    """CREATE, a bulk load, INSERT, DELETE and SELECT through the dialect."""
    engine = Engine(spark)
    engine.execute_sql("CREATE TABLE places (id INT KEY INDEX SEQ, name VARCHAR[100]);")
    engine.catalog.append("places", table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    out = engine.execute_sql("INSERT INTO places VALUES (99, 'NOWHERE'); DELETE FROM places WHERE id = 7; SELECT * FROM places;")
    if not out.success:
        raise ValueError(out.errors)
    return out.result


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def csv_load(spark, sf_dir):
    """CREATE TABLE ... FROM FILE over a CSV copy of a table, in the shared folder where there is one."""
    engine = Engine(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="csv-")
    path = f"{folder}/regions-{id(engine)}"
    table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    out = engine.execute_sql(f"CREATE TABLE regions FROM FILE '{path}' USING INDEX ISAM('id'); SELECT * FROM regions;")
    if not out.success:
        raise ValueError(out.errors)
    return out.result


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked full-text search."""
    return text_search_topk(spark, sf_dir)
