"""The learned operators against enumeration, finite differences and plain Python, and the store against losses."""

import itertools
import os
import random
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import common, langid, quality, tokens, tokenstore, toxicity

SF = "/root/testdata/sf0.001"
WORD_BPE = tokens.public_path("word_bpe_49k.json")


@pytest.mark.parametrize("block", [64, 3, 2])
@pytest.mark.parametrize("lengths", [[1, 2, 5], [6], [3, 1]])
def test_forward_backward_by_enumeration(lengths, block):
    rng, k = np.random.default_rng(3), 3
    emission, transitions = rng.normal(size=(sum(lengths), k)), rng.normal(size=(k, k))
    p, log_z, pairs = langid.forward_backward(emission, np.repeat(np.arange(len(lengths)), lengths), transitions, True, block=block)
    want_p, want_pairs, want_z, at = np.zeros_like(p), np.zeros((k, k)), 0.0, 0
    for n in lengths:
        z, own, two = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=n):
            w = np.exp(sum(emission[at + i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in itertools.pairwise(path)))
            z += w
            for i, y in enumerate(path):
                own[i, y] += w
            for a, b in itertools.pairwise(path):
                two[a, b] += w
        want_p[at : at + n], want_pairs, want_z, at = own / z, want_pairs + two / z, want_z + np.log(z), at + n
    assert np.allclose(p, want_p) and np.allclose(pairs, want_pairs) and log_z == pytest.approx(want_z)


def test_a_long_chain_is_one_chain():
    rng = np.random.default_rng(5)
    emission, transitions = rng.normal(size=(1000, 4)), 3 * rng.normal(size=(4, 4))
    whole = langid.forward_backward(emission, np.zeros(1000, dtype=int), transitions, block=5000)[0]
    assert np.allclose(langid.forward_backward(emission, np.zeros(1000, dtype=int), transitions)[0], whole)


def test_noisy_or_gradient_by_differences():
    rng = np.random.default_rng(1)
    sentence, word = np.sort(rng.integers(0, 12, 60)), rng.integers(0, 7, 60)
    doc = np.sort(rng.integers(0, 5, 12))
    plain, y, weight = rng.integers(0, 3, 5).astype(float), np.array([0.0, 1, 0, 1, 1]), np.array([1.0, 2, 1, 2, 2])
    theta = rng.normal(size=8) - 0.5

    def slow(t: np.ndarray) -> float:  # sentence by sentence
        total = 0.0
        for d in range(5):
            none = (1 - 1 / (1 + np.exp(-t[-1]))) ** plain[d]
            for s in range(12):
                if doc[s] == d:
                    none *= 1 - 1 / (1 + np.exp(-(t[-1] + sum(t[w] for a, w in zip(sentence, word, strict=True) if a == s))))
            total -= weight[d] * np.log(1 - none if y[d] else none)
        return total / 5

    loss, grad = toxicity.loss_and_gradient(theta, sentence, word, doc, plain, y, weight)
    assert loss == pytest.approx(slow(theta))
    for i in range(8):
        step = np.eye(8)[i] * 1e-5
        assert grad[i] == pytest.approx((slow(theta + step) - slow(theta - step)) / 2e-5, rel=1e-4, abs=1e-7)


def test_score_is_the_noisy_or_of_sentences():
    model = toxicity.Model({"bad": 2.0, "good": -1.0, "evil": 2.0, "wond~": 0.5}, -1.5)
    text = "Bad bad evil day. good\nWonderful evil! 12 ... evil bad"
    keep = 1.0
    for words in (["bad", "evil", "day"], ["good"], ["wonderful", "evil"], ["evil", "bad"]):  # bad bad counts once, evil beside it is another word
        z = -1.5 + sum(model.weights.get(f, 0.0) for w in words for f in toxicity.features(w))
        keep *= 1 - 1 / (1 + np.exp(-z))
    assert model.score(text) == pytest.approx(1 - keep)
    middling = toxicity.Model({"meh": 1.0}, -1.2)
    many = "one meh. two meh. three meh, so meh."
    assert middling.score(many) > 0.5 and len(middling.locate(many)) == 1 and middling.locate("") == middling.locate("1 2") == []


def test_toxic_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    auc = np.mean([a > b for a in out[out["toxic"] == 1]["score"] for b in out[out["toxic"] == 0]["score"]])
    assert auc > 0.9 and out[out["toxic"] == 0]["predicted"].mean() < 0.05
    held = {r["doc_id"]: r["held_out"] for r in toxicity.score(docs, toxicity.Model({}, 0.0)).collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in held.items())


def plain_verdict(counts: dict, rules: list) -> bool:
    if counts["n_words"] < 50 or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]:
        return False
    for rule in rules:
        values = [counts[quality.RATIOS[n][0]] / max(counts[quality.RATIOS[n][1]], 1) for n, _, _ in rule]
        if all(v >= cut if sign == ">=" else v <= cut for v, (_, sign, cut) in zip(values, rule, strict=True)):
            return False
    return True


def plain_counts(text: str | None) -> dict:
    found = [w for w in "".join(" " if c in common.SPACE else c for c in text or "").split(" ") if w]
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(common.SPACE)]
    upper = sum(any("A" <= c <= "Z" for c in w) and not any("a" <= c <= "z" for c in w) for w in found)
    return dict(zip(quality.COUNTS, (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(lines), len(set(found)), upper), strict=True))


def test_counts_list_and_verdict_row_by_row(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rng = random.Random(2)
    odd = ["".join(rng.choice(["a", "B", "#", "é", " ", "\n", "\t", " x y z ", "|", "\x1c", "　"]) for _ in range(rng.randrange(300))) for _ in range(80)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([*odd, None, ""])], "doc_id long, text string"))
    rules = [[("symbols_per_word", ">=", 0.2)], [("upper_words", ">=", 0.3), ("distinct_words", "<=", 0.6)], *quality.train(docs, labels)]
    out = {r["doc_id"]: r for r in quality.quality(docs, rules).collect()}
    passed = 0
    for r in docs.collect():
        want = plain_counts(r["text"])
        got = out[r["doc_id"]]
        assert {c: got[c] for c in quality.COUNTS} == want, r["doc_id"]
        assert got["kept"] == plain_verdict(want, rules) and got["base_failed"] == (not plain_verdict(want, []))
        passed += got["kept"]
    assert 0 < passed < len(out)
    kept = {r["doc_id"] for r in quality.keep_good(docs, rules).collect()}
    assert kept == {d for d, r in out.items() if r["kept"]}


def test_rules_are_grown_and_pruned():
    rng = np.random.default_rng(4)
    x = pd.DataFrame({"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)})
    reject = ((x["a"] > 0.8) & (x["b"] < 0.5) | (x["c"] > 0.9)).to_numpy()
    rules = quality.learn(x, reject)
    hit = np.zeros(len(x), dtype=bool)
    for rule in rules:
        hit |= quality._matches(x, rule)
    assert len(rules) > 1 and (hit == reject).mean() > 0.97
    assert quality.learn(x, rng.random(3000) < 0.3) == []  # nothing precise to learn


def test_counts_are_made_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for out in (quality.quality(docs, []), quality.keep_good(docs, [[("upper_words", ">=", 0.3)]])):
        assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def slow_cuts(ids: list[int]) -> list[int]:
    out, start = [], 0
    for i in range(1, len(ids) + 1):
        rolled = sum(int(tokenstore._GEAR[x]) << k for k, x in enumerate(reversed(ids[max(0, i - tokenstore.SPAN) : i]))) % 2**64
        n = i - start
        if i == len(ids) or n >= tokenstore.LEAST and len(ids) - start > tokenstore.LEAST and (rolled >> (64 - tokenstore.BITS) == 0 or n == tokenstore.MOST):
            out.append(i)
            start = i
    return out


def test_cuts_follow_the_rolling_hash():
    rng = np.random.default_rng(8)
    streams = [rng.integers(0, 49_000, n).tolist() for n in (1, 64, 65, 3000, 10, 1, 700)] + [[7] * 2500]
    ends, counts = tokenstore.cuts(np.array([x for s in streams for x in s], dtype="<u2"), np.cumsum([len(s) for s in streams]))
    want, at = [], 0
    for s in streams:
        want.append([at + x for x in slow_cuts(s)])
        at += len(s)
    assert ends == [x for w in want for x in w] and counts == [len(w) for w in want]


@pytest.mark.parametrize("lost", ["chunks", "recipes", "manifest"])
def test_a_lost_file_is_an_error(spark, tmp_path, lost):
    path = f"file://{tmp_path}/store"
    tokenstore.write_store(spark.read.parquet(f"{SF}/documents.parquet").repartition(3), path, WORD_BPE)
    files = sorted(Path(tmp_path, "store", lost).glob("part-*"), key=lambda p: p.stat().st_size)
    os.remove(files[-1])
    for crc in Path(tmp_path, "store", lost).glob(".*.crc"):
        os.remove(crc)
    message = ("lost chunk" if lost == "chunks" else "manifest") + "|UNABLE_TO_INFER"  # the latter where there was one file
    with pytest.raises(Exception, match=message):
        tokenstore.read_sums(spark, path).collect()
    with pytest.raises(Exception, match=message):
        tokenstore.read_ids(spark, path).collect()


def test_a_changed_or_repeated_recipe_is_an_error(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    tokenstore.write_store(spark.createDataFrame([(i, f"text number {i}") for i in range(50)] + [(None, "x")] * 3, "doc_id long, text string"), path, WORD_BPE)
    assert len(tokenstore.read_ids(spark, path).collect()) == 53
    spark.read.parquet(f"{path}/recipes").write.parquet(f"{path}/saved")
    recipes = spark.read.parquet(f"{path}/saved")
    for changed in (recipes.union(recipes.where("doc_id = 7")), recipes.withColumn("doc_id", F.when(F.col("doc_id") == 7, 8).otherwise(F.col("doc_id"))), recipes.where("doc_id is not null").union(recipes.where("doc_id is null").limit(2))):
        changed.write.mode("overwrite").parquet(f"{path}/recipes")
        with pytest.raises(RuntimeError, match="manifest"):
            tokenstore.checked_recipes(spark, path)


def test_many_recipes_of_one_span_fall_into_cells(spark):
    rows = [(None, 1, i.to_bytes(16, "big")) for i in range(20_000)] + [(5, 1, b"same" * 4)] * 20_000
    out = tokenstore._manifest(spark.createDataFrame(rows, "doc_id long, n_tokens long, root binary")).groupBy("part").agg(F.count("*").alias("cells"), F.sum("n_docs").alias("n"), F.max("n_docs").alias("most")).collect()
    cells = {r["part"]: (r["cells"], r["n"], r["most"]) for r in out}
    assert cells[0] == (1, 20_000, 20_000) and cells[None][1] == 20_000 and cells[None][2] < 1200
