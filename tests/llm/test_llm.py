"""The training-data operators against brute force, exact round trips and held-out labels, with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import components, exactdup, langid, linededup, mixing, neardup, packing, quality, queries, tokencounts, tokens, tokenstore, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _row string, label string"
ODD = [
    (1, None, None, None, None, "s", "r", "x"), (2, "", "en", "b", 0, "s", "r", "x"), (3, " \t\n\x0b", "en", "b", 0, None, None, None), (4, "One. two", None, "a", 3, None, None, None), (5, "One. two", "en", None, 3, None, None, None),
    (5, "One. two", "en", None, 3, None, None, None), (None, "lost words here", "en", "a", 3, None, None, None), (6, "word " * 30_000, "en", "a", 3, None, None, None), (7, "  a  b\n\n c  ", "en", "b", 3, None, None, None),
]
WORD_BPE, BYTE_BPE, RANKS = (tokens.public_path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def ops(docs, labels):
    return {
        "mix": lambda d: mixing.mix(d), "toxic": lambda d: toxicity.score(d, toxicity.train(docs, labels)), "near": lambda d: neardup.near_duplicates(d), "store": lambda d: tokenstore.store_and_verify(d, WORD_BPE), "quality": lambda d: quality.quality(d, quality.train(docs, labels)),
        "lang": lambda d: langid.identify(d, langid.train(docs)), "lines": lambda d: linededup.line_report(d), "exact": lambda d: exactdup.exact_duplicates(d), "counts": lambda d: tokencounts.token_counts(d, RANKS), "pack": lambda d: packing.pack(d, BYTE_BPE),
    }


@pytest.mark.parametrize("name", ["mix", "toxic", "near", "store", "quality", "lang", "lines", "exact", "counts", "pack"])
def test_odd_rows_and_empty_tables(odd, none, docs, labels, name):
    run = ops(docs, labels)[name]
    out = run(odd).toPandas()
    assert len(out) >= len(ODD) and {int(x) for x in out["doc_id"].dropna()} == {1, 2, 3, 4, 5, 6, 7}
    assert run(none).count() == 0


def test_mixing_targets(spark, docs):
    out = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    by = out.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["source_size"]).all() and ((by["target"] - by["taken"]).abs() < 1).all() and (out["taken"] <= 3 * out["size"]).all()
    weights, total = np.array([5, 2, 1] * 7)[: len(by)].astype(float), by["size"].sum()
    want, open_ = np.zeros(len(by)), np.ones(len(by), dtype=bool)
    while True:  # share, cap, share the excess again
        want = np.where(open_, (total - (3 * by["size"])[~open_].sum()) * weights / weights[open_].sum(), 3 * by["size"])
        if not (over := open_ & (want > 3 * by["size"])).any():
            break
        open_ &= ~over
    assert np.allclose(want, by["target"])


def test_one_capped_source(spark):
    rows = [(i, "w " * 10, "a") for i in range(3)] + [(9, "w " * 970, "b")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert set(out[out["source_size"] == 30]["target"]) == {90.0} and set(out[out["source_size"] == 970]["target"]) == {910.0}
    assert out["taken"].sum() == 1000


@pytest.mark.parametrize("schedules", [mixing.SCHEDULES, [[(0.0, 0.0), (1.0, 4.0)], [(0.0, 3.0), (0.3, 0.0), (1.0, 1.0)]]])
def test_copies_by_brute_force(spark, schedules):
    rng, rows = random.Random(7), []
    for i in range(60):
        text = "".join(rng.choice(["", " ", "\n\t "]) + f"w{k}" + rng.choice([" ", "\n", "  \x0b"]) for k in range(rng.choice([0, 1, 3, 20, 90])))
        rows.append((rng.choice([i, i, i, 5, None]), text if i % 9 else None, rng.choice(["a", "b", "b", "b", "b", None]), i))
    rows += [(5, "again and again", "b", 90)] * 2 + [(70, "x " * 400, "b", 91)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other long")
    keys = [r[0] for r in docs.select(F.xxhash64(F.col("doc_id").cast("string"), F.lit("order")), F.xxhash64("text")).collect()]
    marks = [r[0] for r in docs.select(F.xxhash64("text")).collect()]
    n = [len((r[1] or "").split()) for r in rows]
    targets = {r["source_size"]: r["target"] for r in mixing.mix(docs, schedules).collect()}
    want, sources = [], ["a", "b", None]
    for rank, source in enumerate(sources):
        order = sorted((i for i, r in enumerate(rows) if r[2] == source), key=lambda i: (keys[i] % mixing.SLICES, keys[i], -1 if rows[i][0] is None else rows[i][0], n[i], marks[i]))
        size = sum(n[i] for i in order)
        at, (t, w) = 0, np.array(schedules[rank % len(schedules)]).T
        grid = np.unique(np.concatenate([np.linspace(0, 1, 20_001), t]))
        area = np.concatenate([[0], np.cumsum(np.diff(grid) * (np.interp(grid, t, w)[1:] + np.interp(grid, t, w)[:-1]) / 2)])
        for copy in range(mixing.REPEATS):
            for i in order:
                words = min(n[i], max(0, int(np.floor(targets[size])) - at))
                if words:
                    want.append((rows[i][0], copy, words, float(np.interp(at / targets[size], area / area[-1], grid)), i))
                at += n[i]
    got = [tuple(r) for r in mixing.copies(docs, schedules).select("doc_id", "copy", "words", "position").collect()]
    by = lambda r: (-1 if r[0] is None else r[0], r[1], r[2], r[3])
    assert len(got) == len(want) and len({len(schedules)} | {r[1] for r in got}) > 1
    for a, b in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=2e-3)
    mixed = [tuple(r) for r in mixing.mixed_documents(docs, schedules).collect()]
    report = [tuple(r) for r in mixing.mix(docs, schedules).select("doc_id", "taken", "positions").collect()]
    sums = lambda pairs: {d: sum(x for e, x in pairs if e == d) for d, x in pairs if x}
    assert sums([(r[0], r[1]) for r in report]) == sums([(r[0], len(r[1].split())) for r in mixed]) == sums([(r[0], r[2]) for r in want])
    firsts = [p[0] for _, _, p in report if p]
    assert firsts == sorted(firsts) and sorted(x for _, _, p in report for x in p) == sorted(r[3] for r in got)
    assert [r[0] for r in mixed] == [r[0] for r in sorted(got, key=lambda r: (r[3], -1 if r[0] is None else r[0], r[1]))]
    texts = {r[3]: (r[0], r[2], r[1]) for r in rows}
    cut = [r for r in mixed if r[1] != texts[r[3]][2]]
    assert all((r[0], r[2]) == texts[r[3]][:2] and texts[r[3]][2].startswith(r[1]) and r[1].split()[-1:] == r[1].rstrip().split()[-1:] for r in mixed)
    assert len(cut) <= len(sources) and all(not r[1][-1].isspace() for r in cut)


def test_schedule_shapes_show_in_the_mix(spark, docs):
    early, late = [[(0.0, 2.0), (1.0, 0.0)], [(0.0, 1.0), (1.0, 1.0)]], [[(0.0, 0.0), (1.0, 2.0)], [(0.0, 1.0), (1.0, 1.0)]]
    a, b = (mixing.mix(docs, x).toPandas().set_index("doc_id") for x in (early, late))
    assert (a["taken"] == b["taken"].reindex(a.index)).all() and a["positions"].map(tuple).ne(b["positions"].map(tuple).reindex(a.index)).any()


def test_schedule_inverts():
    for s in mixing.SCHEDULES:
        t = mixing.due(s, np.linspace(0, 1, 11))
        total = mixing.integral(s)
        for x, share in zip(t, np.linspace(0, 1, 11), strict=True):
            at = np.linspace(0, x, 2001)
            area = np.trapezoid(np.interp(at, total[:, 0], total[:, 1]), at)
            assert area == pytest.approx(share * total[-1, 2], abs=1e-4)


def brute_components(texts: dict[int, str | None]) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                for i in root:
                    if root[i] in (x, y):
                        root[i] = min(x, y)
    return root


def test_near_duplicates(spark, docs):
    rng, rows = random.Random(3), [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    for i in range(1000, 1040):  # near copies whose copies are not all near one another, and a chain
        w = list(base)
        for k in rng.sample(range(120), 3 if i % 2 else 2):
            w[k] = f"x{i}"
        rows.append((i, " ".join(w)))
    chain = [f"c{k}" for k in range(100)]
    for i in range(2000, 2030):
        chain = [*chain[4:], *(f"d{i}-{k}" for k in range(4))]
        rows.append((i, " ".join(chain)))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    want = brute_components(dict(rows))
    assert dict(zip(out["doc_id"], out["component_id"], strict=True)) == want
    assert (out["kept"] == (out["doc_id"] == out["component_id"])).all()


def test_components(spark):
    rng = random.Random(1)
    edges = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(220)} | {(i, i + 1) for i in range(400, 480)}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    found = components.components(spark.createDataFrame(list(edges), "u long, v long")).toPandas()
    assert dict(zip(found["node"], found["component"], strict=True)) == root


def test_store_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = f"file://{tmp_path}/store"
    tokenstore.write_store(docs, path, WORD_BPE)
    ids = {r["doc_id"]: list(r["ids"]) for r in tokenstore.read_ids(spark, path).collect()}
    t, start = Tokenizer.from_file(WORD_BPE), 0
    sums = {r["doc_id"]: r for r in tokenstore.read_sums(spark, path).collect()}
    for r in docs.orderBy("doc_id").collect():
        want = [*t.encode(r["text"], add_special_tokens=False).ids, 1]
        assert ids[r["doc_id"]] == want
        s = sums[r["doc_id"]]
        assert (s["start"], s["n_tokens"], s["ids_crc32"]) == (start, len(want), zlib.crc32(np.array(want, dtype="<u4").tobytes()))
        start += len(want)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_crc_of_parts():
    a, b = b"some bytes", b"and more of them" * 50
    assert int(tokenstore.shifted(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize(("path", "blank"), [(WORD_BPE, False), (BYTE_BPE, True)])
def test_units_encode_as_whole(path, blank):
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(path), random.Random(5)
    texts = ["".join(rng.choice(["a", "It's", "é", " ", "  ", "\n", "\t ", "7", "!?", " ", "　", "é", "Ω", "\x1c", "\r\n"]) for _ in range(30)) for _ in range(400)]
    got = tokens.UnitEncoder(path, blank, "<u4", 300).encode(texts) + tokens.UnitEncoder(path, blank, "<u4", 300).encode([None, ""])
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts] + [[], []]


def test_quality_counts():
    text = "a b c a b c d\n\nx\nx\n \t\n$ 5"
    n, chars, symbols, dup, repeated = quality.text_counts(text)[:5]
    words = text.encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    assert (n, chars, symbols, dup, repeated) == (11, 11, 1, 1, len(covered)) and repeated == 6


def test_quality_rules(docs, labels):
    rules = quality.train(docs, labels)
    out = quality.quality(docs, rules).join(labels, "doc_id").where("not base_failed").toPandas()
    assert out[out["quality"] == 1]["kept"].mean() > 0.95
    x = pd.DataFrame({"a": np.arange(300) % 100 / 100.0, "b": 0.5})
    assert quality.learn(x, (x["a"] > 0.8).to_numpy())


def test_language_and_words(docs):
    model = langid.train(docs)
    out = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.95
    texts = {r["lang"]: r["text"] for r in docs.where("length(text) > 300").collect()}
    both = texts["en"][:150].replace(".", " ") + " " + texts["de"][:150].replace(".", " ")
    found = [lang for _, lang, _ in model.label_words(both)]
    assert found[:5].count("en") >= 4 and found[-5:].count("de") >= 4
    assert model.predict(["123 ...", None, ""]) == [("und", 0.0)] * 3


def test_toxic_sentences():
    rng = random.Random(2)
    word = lambda: rng.choice("lorem ipsum dolor sit amet erat urna quam".split())
    texts, y = [], []
    for i in range(200):
        sentences = [" ".join(word() for _ in range(6)) for _ in range(5)]
        if i % 4 == 0:
            sentences[2] = "you idiot " + sentences[2]
        texts.append(". ".join(sentences))
        y.append(int(i % 4 == 0))
    model = toxicity.fit(texts, np.array(y))
    assert all((model.score(t) >= 0.5) == bool(k) for t, k in zip(texts, y, strict=True))
    (start, end, _), *rest = model.locate(texts[0])
    assert "idiot" in texts[0][start:end] and not rest
    assert model.score("") == 0.0 and 0 <= model.score("x " * 10_000) <= 1


def test_lines(spark):
    long = " ".join(f"p{i}" for i in range(30))
    more = "\n".join(" ".join(f"q{j}-{i}" for i in range(9)) for j in range(7))
    rows = [(1, f"first\n{long}\n{more}\nend"), (2, f"other\nwords\n{more}\n\nnew"), (3, f"{long}\ntail one"), (4, "first\nend")]
    out = {r["doc_id"]: r for r in linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["n_deleted"] == 0 and out[1]["text"] == rows[0][1]
    assert out[2]["text"] == "other\nwords\n\nnew" and out[3]["text"] == "tail one" and out[4]["text"] == "first\nend"


@pytest.mark.parametrize("size", [1, 3, 4, 5, 8, 12, 24, 49, 60])
def test_spaced_lines(spark, size):
    rng = random.Random(size)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = lambda n: [" ".join(word() for _ in range(min(size, n - k))) for k in range(0, n, size)]
    spaced = lambda x, blank: "".join(f"{y}\n{blank}" for y in x)
    rows, left = [], {}
    for i, n in enumerate([49, 50, 73, 100, 200]):
        x = passage(n)
        for k, blank in enumerate(["\n", "\n", "", "\n \t\n"]):  # the last two are spaced in another way
            head, tail = word(), word()
            rows.append((10 * i + k, f"{head}\n\n{spaced(x, blank)}{tail}"))
            left[10 * i + k] = rows[-1][1] if k == 0 else f"{head}\n{tail}" if k < 3 else None
        rows.append((10 * i + 9, spaced(x, "\n")))
        left[10 * i + 9] = ""
    out = {r["doc_id"]: r for r in linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = set()  # by brute force: a line of a passage stays where it occurs first only
    for i, text in rows:
        stays = [y for y in text.split("\n") if y.strip() and y not in seen]
        seen.update(text.split("\n"))
        assert [y for y in out[i]["text"].split("\n") if y.strip()] == stays
        assert out[i]["n_lines"] - out[i]["n_deleted"] in ([len(out[i]["text"].split("\n"))] if out[i]["text"] else [0, 1])
        assert left[i] is None or out[i]["text"] == left[i]


def test_rows_that_share_an_id(spark):
    passage = lambda c: "\n".join(" ".join(f"{c}{j}-{i}" for i in range(9)) for j in range(7))
    a, b, c = map(passage, "abc")
    rows = [(1, f"{a}\none"), (1, f"{a}\none"), (2, f"two\n{a}"), (3, f"{b}\nthree"), (4, f"four\n{b}"), (4, f"four\n{b}"), (5, f"{c}\nfive"), (5, f"other\nwords here\n{c}"), (6, f"{c}\nsix")]
    out = sorted(r[0] for r in linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).select(F.struct("doc_id", "text")).collect())
    five = [t for d, t in out if d == 5]
    assert [tuple(r) for r in out if r[0] != 5] == [(1, rows[0][1])] * 2 + [(2, "two"), (3, rows[3][1]), (4, "four"), (4, "four"), (6, "six")]
    assert sorted(five) in (sorted(["five", rows[7][1]]), sorted([rows[6][1], "other\nwords here"]))


def test_many_blank_lines(spark):
    x = "\n".join(" ".join(f"m{j}-{i}" for i in range(9)) for j in range(7))
    rows = [(1, "a" + "\n" * 20_000 + x), (2, "b" + "\n" * 30_000 + x), (3, "\n" * 1000)]
    out = {r["doc_id"]: r["text"] for r in linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: "b" + "\n" * 10_000, 3: rows[2][1]}


def test_line_and_exact_oracles(spark, docs):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        columns = sorted(want.columns)
        assert sorted(map(repr, got[columns].values.tolist())) == sorted(map(repr, want[columns].values.tolist()))


def test_fingerprints_compose():
    data = random.Random(1).randbytes(50_001)
    whole = exactdup.fingerprint(data)
    for cut in (0, 1, 4096, 33_333, 50_001):
        assert exactdup.combine(exactdup.fingerprint(data[:cut]), exactdup.fingerprint(data[cut:])) == whole


def test_exact(spark):
    rows = [(1, "a b"), (2, "ab "), (3, "a  b"), (4, None), (5, ""), (6, "other")]
    out = {r["doc_id"]: r for r in exactdup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i]["keep_id"] for i in range(1, 7)] == [3, 3, 3, 4, 4, 6] and out[3]["kept"] and out[1]["group_size"] == 3
    assert out[1]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()


def test_counts_are_viterbi():
    counter = tokencounts.TrieCounter.of_ranks(RANKS)
    scores = counter.scores

    def slow(w: bytes) -> int:
        best = [(0.0, 0)]
        for j in range(1, len(w) + 1):
            found = [(best[i][0] + scores[w[i:j]], best[i][1] + 1) for i in range(j) if w[i:j] in scores]
            top = max(s for s, _ in found)
            best.append((top, min(n for s, n in found if s > top - 1e-9)))
        return best[-1][1]

    words = "thereof unbelievably élan ñandú x hello hellos 12345 $$$ Überraschung".split()
    assert counter.count([" ".join(words), None]) == [(len(words), sum(slow(b" " + w.encode()) for w in words)), (0, 0)]


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    ids = {r["doc_id"]: [*t.encode(r["text"], add_special_tokens=False).ids, 0] for r in docs.collect()}
    out = packing.pack(docs, BYTE_BPE).toPandas()
    for r in out.itertuples():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32
    assert out["length"].sum() == sum(map(len, ids.values()))
    placed = out.sort_values(["sequence_id", "offset"])
    assert (placed["offset"] == placed.groupby("sequence_id")["length"].cumsum() - placed["length"]).all()
    assert placed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert out["sequence_id"].nunique() <= np.ceil(out["length"].sum() / 2048) * 1.05 + 2


def test_packing_plan_uses_every_rank():
    histogram = np.random.default_rng(4).integers(0, 40, 513)
    rows, n = packing.plan(histogram)
    used = np.zeros(513, dtype=int)
    fill = np.zeros(n, dtype=int)
    for length, rank, count, first, offset in rows:
        assert rank == used[length]
        used[length] += count
        assert (fill[first : first + count] == offset).all()
        fill[first : first + count] += length
    assert (used[1:] == histogram[1:]).all() and fill.max() <= 512


def test_pipeline(spark, odd, docs, tmp_path):
    import corpus_pipeline as p

    rows = docs.select(*docs.columns)
    rows = rows.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(odd.select(*docs.columns))
    for k, (_, stage) in enumerate(p.STAGES[:-1]):
        before = rows
        stage(spark, rows, SF).write.parquet(f"{tmp_path}/{k}")
        rows = spark.read.parquet(f"{tmp_path}/{k}")
        assert rows.columns == docs.columns
        if k in (0, 2):  # cut copies may leave the third stage none to drop
            assert rows.count() < before.count() + (k == 2)
        if k == 1:
            assert rows.count() == before.count()
    assert p.STAGES[-1][1](spark, rows, SF).count() >= rows.count() > 0
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_blocks_join_all_that_are_near():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 100, dtype=np.uint64)
    rows = [np.unique(np.concatenate([base[int(cut) :], rng.integers(0, 2**62, int(cut), dtype=np.uint64)])) for cut in rng.integers(0, 30, 40)]
    found = neardup._in_cluster(pd.DataFrame({"node": range(40), "label": range(40), "probe": [k > 0 for k in range(40)], "hashes": [x.tobytes() for x in rows]}))
    root = list(range(40))
    for u, v in found.to_numpy():
        assert 100 * len(np.intersect1d(rows[u], rows[v])) >= 75 * len(np.union1d(rows[u], rows[v]))
        root = [root[u] if x == root[v] else x for x in root]
    assert len(found) <= 39
    for u in range(40):
        for v in range(u):
            if 100 * len(np.intersect1d(rows[u], rows[v])) >= 75 * len(np.union1d(rows[u], rows[v])):
                assert root[u] == root[v]
