import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.functions.stemmer import stem
from sparkloom.functions.text import preprocess, stopwords
from sparkloom.operators import similarity, spatial, structures, textindex
from sparkloom.plans import catalogue


@pytest.fixture(scope="module")
def products(spark):
    rows = [(10, "A"), (11, "B"), (15, "C"), (20, "D"), (20, "D2"), (25, "E"), (30, "F")]
    return spark.createDataFrame(rows, "id int, nombre string")


def test_isam(products):
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(structures.isam_range(products, "id", 11, 18)) == [11, 15]
    assert ids(structures.isam_range(products, "id", 30, 15)) == [15, 20, 20, 25, 30]
    assert ids(structures.key_range(products, "id", 30, 15)) == []
    left = structures.delete(products, F.col("id") == 11)
    assert ids(structures.isam_range(left, "id", 10, 20)) == [10, 15, 20, 20]


def test_places(spark):
    rows = spark.createDataFrame([("1", 10.0, 20.0), ("2", 15.0, 25.0), ("3", 50.0, 80.0), ("4", 12.0, 22.0)], "id string, x double, y double")
    assert {r["id"] for r in spatial.range_search(rows, ["x", "y"], [11.0, 21.0], 5.0).collect()} == {"1", "4"}
    assert spatial.range_search(rows, ["x", "y"], [1000.0, 1000.0], 1.0).isEmpty()
    assert spatial.range_search(rows, ["x", "y"], [1.0, 1.0, 1.0], 1.0).isEmpty()
    assert [r["id"] for r in spatial.nearest(rows, ["x", "y"], [11.0, 21.0], 2, "id").collect()] == ["1", "4"]


def test_hand_index(spark):
    docs = spark.createDataFrame([(1, "a1 a1 b1"), (2, "a1 c1"), (3, "c1 c1 d1")], "doc_id int, text string")
    w = {(r["doc_id"], r["term"]): r["w"] for r in textindex.weights(textindex.frequencies(docs, "doc_id", "text"), 3).collect()}
    assert w[1, "a1"] == pytest.approx(1.30103 * 0.1760913, abs=1e-6) and w[1, "b1"] == pytest.approx(0.4771213, abs=1e-6)


def test_terms(spark):
    row = spark.range(1).select(preprocess(F.lit("El aprendizaje automático es una rama de la inteligencia artificial."), stems=False).alias("t")).head()
    assert row["t"] == ["aprendizaje", "automático", "rama", "inteligencia", "artificial"]
    assert len(stopwords()) == 313


@pytest.mark.parametrize(
    ("word", "found"),
    [("chicharrones", "chicharron"), ("cheque", "chequ"), ("torear", "tor"), ("tórax", "torax"), ("inteligencia", "inteligent"), ("corriendo", "corr"), ("perros", "perr"), ("absolutamente", "absolut"), ("hacerlo", "hac"), ("habla", "habl")],
)
def test_stems(word, found):
    assert stem(word) == found


def test_codebook_sizes():
    assert similarity.codebook_size("image", 17_000, 30) == 500
    assert similarity.codebook_size("audio", 12_000, 30) == 60
    assert similarity.must_rebuild("image", 10, None) and not similarity.must_rebuild("image", 19, 10) and similarity.must_rebuild("audio", 20, 10)


def test_engine(spark, tmp_path):
    items = spark.createDataFrame([(i, f"n{i}") for i in range(6)], "item_id long, name string")
    rows = [(i, j, [float(i % 2) * 5 + j * 0.01, float(i % 3)]) for i in range(6) for j in range(8)]
    descriptors = spark.createDataFrame(rows, "item_id long, desc_no int, descriptor array<double>")
    e = similarity.SimilarityEngine(spark, "audio", str(tmp_path))
    with pytest.raises(ValueError):
        e.search(descriptors)
    assert e.add(items, descriptors)
    best = e.search(descriptors.where("item_id = 3"), 3).collect()
    assert best[0]["name"] == "n3" and best[0]["sim"] == pytest.approx(1.0, abs=1e-5)
    assert e.stats()["items"] == 6


def test_near_ties_are_ranked_by_exact_values(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0006]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "id int, v array<double>")
    assert [r["id"] for r in similarity.exact_search(rows, "id", "v", [1.0, 0.0], 2).collect()] == [2, 1]
    assert [r["id"] for r in similarity.threshold_search(rows, "id", "v", [1.0, 0.0], 0.9999999).collect()] == [2]
    places = spark.createDataFrame([(1, 1.0000002, 0.0), (2, 1.0000001, 0.0)], "id int, x double, y double")
    assert [r["id"] for r in spatial.nearest(places, ["x", "y"], [0.0, 0.0], 1, "id").collect()] == [2]


@pytest.mark.parametrize("kind", ["image", "audio"])
def test_a_query_is_cut_or_padded(spark, kind):
    rows = spark.createDataFrame([(1, [3.0, 4.0, 0.0]), (2, [0.6, 0.8])], "id int, v array<double>")
    found = {n: {r["id"]: r["sim"] for r in similarity.exact_search(rows, "id", "v", q, 5, kind).collect()} for n, q in (("short", [1.0]), ("long", [3.0, 4.0, 0.0, 7.0]))}
    scale = 1.0 if kind == "image" else 5.0
    assert found["short"] == pytest.approx({1: 0.6 * scale, 2: 0.6}) and found["long"] == pytest.approx({1: scale, 2: 1.0})


def test_assign_keeps_nulls_and_ties(spark):
    rows = spark.createDataFrame([(1, [0.5]), (2, None), (3, [1.9])], "id int, v array<float>")
    assert {r["id"]: r["word"] for r in similarity.assign(rows, "v", [(7, [1.0]), (4, [0.0])]).collect()} == {1: 4, 2: None, 3: 7}


def test_index_versions(spark, tmp_path):
    index = textindex.TextIndex(spark, f"file://{tmp_path}", stems=False)
    index.build(spark.createDataFrame([(1, "alfa beta"), (2, "gama delta")], "doc_id int, text string"))
    planned = index.search("alfa")
    index.build(spark.createDataFrame([(3, "alfa beta"), (4, "omega")], "doc_id int, text string"))
    assert [r["doc_id"] for r in planned.collect()] == [1] and [r["doc_id"] for r in index.search("alfa").collect()] == [3]


def test_nearest_in_three_dimensions(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0, 3.0]), (2, [0.0, 4.0, 3.0]), (3, [0.0, 0.0])], "id int, p array<double>")
    assert [(r["id"], r["dist"]) for r in spatial.nearest_array(rows, "p", [0.0, 0.0, 0.0], 5, "id").collect()] == [(1, 3.0), (2, 5.0)]


def test_each_distinct_word_is_stemmed_once(monkeypatch):
    pa, asked = pytest.importorskip("pyarrow"), []
    monkeypatch.setattr(text, "stem", lambda w: asked.append(w) or stem(w))
    text._remembered.cache_clear()
    long = "perros" * 20
    lists = [["perros", "cheque"] * 500, None, [], ["cheque", "perros", long, None, long]]
    want = [None if ws is None else [w and stem(w) for w in ws] for ws in lists]
    assert text.stem_lists(pa.array(lists, pa.list_(pa.string()))).to_pylist() == want
    assert sorted(asked) == sorted(["perros", "cheque", long])
    assert text.stem_lists(pa.array(lists, pa.list_(pa.string())).slice(1, 3)).to_pylist() == want[1:]
    assert sorted(asked) == sorted(["perros", "cheque", long, long])
    text._remembered.cache_clear()


def test_stems_of_columns(spark):
    rows = spark.createDataFrame([(1, "Los perros, el perro y más perros"), (2, None), (3, ""), (4, "corriendo cheque")], "doc_id int, text string")
    assert {r["doc_id"]: r["t"] for r in rows.select("doc_id", preprocess(F.col("text")).alias("t")).collect()} == {1: ["perr", "perr", "perr"], 2: [], 3: [], 4: ["corr", "chequ"]}


TEXTS = [(1, "alfa alfa beta gama"), (2, "alfa beta"), (3, "beta delta delta"), (4, None), (5, " "), (None, "alfa omega"), (7, "beta"), (8, "alfa beta epsilon epsilon epsilon")]


def summed(docs, query):
    return {r["doc_id"]: (round(r["_ww"], 9), None if r["_s"] is None else round(r["_s"], 9)) for r in textindex.text_sums(docs, "doc_id", "text", query).collect()}


@pytest.mark.parametrize("most", [2**18, 1, 0])
def test_frequent_terms_change_the_way_not_the_sums(spark, monkeypatch, most):
    query = textindex.query_weights(["alfa", "omega", "omega", "nowhere"])
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    weighted = textindex.weights(textindex.frequencies(docs, "doc_id", "text"), len(TEXTS))
    want = {r["doc_id"]: (round(r["_ww"], 9), None if r["_s"] is None else round(r["_s"], 9)) for r in textindex.sums(weighted, "doc_id", query).collect()}
    monkeypatch.setattr(textindex, "FREQUENT_TERMS", most)
    assert summed(docs, query) == want and want[7][1] is None and 4 not in want and 5 not in want
    twice = spark.createDataFrame([(1, "alfa beta"), (1, "alfa alfa"), (None, "beta"), (None, "gama beta"), (3, "alfa")], "doc_id int, text string")
    weighted = textindex.weights(textindex.frequencies(twice, "doc_id", "text"), 5)
    assert summed(twice, query) == {r["doc_id"]: (round(r["_ww"], 9), None if r["_s"] is None else round(r["_s"], 9)) for r in textindex.sums(weighted, "doc_id", query).collect()}
    assert textindex.text_sums(docs.where("false"), "doc_id", "text", query).isEmpty()


def test_frequent_terms_leave_one_row_a_text():
    pa, np = pytest.importorskip("pyarrow"), pytest.importorskip("numpy")
    lists = pa.array([["a1", "b1", "a1", "c1"], None, [], ["c1"], ["b1"]], pa.list_(pa.string()))
    rows = textindex.weighed(lists, pa.array(["a1", "b1"]), np.array([0.5, 0.25]), {"b1": 2.0, "x": 1.0}).to_pylist()
    assert [[(r["term"], r["tf"]) for r in x] for x in rows] == [[("c1", 1), (None, None)], [], [], [("c1", 1)], [(None, None)]]
    assert rows[0][1]["ww"] == pytest.approx(((1 + np.log10(2)) * 0.5) ** 2 + 0.0625) and rows[0][1]["s"] == 0.5 and rows[4][0] == {"term": None, "tf": None, "ww": 0.0625, "s": 0.5}


@pytest.mark.parametrize("name", ["text_norms", "text_search_topk"])
def test_postings_are_not_gathered_by_term_for_a_join(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1
