"""Exact duplicates against plain Python: ties, extremes of ids, huge texts in parts, and fingerprints that collide."""

import hashlib
import random
import tracemalloc

import pyarrow as pa
import pytest

from sparkloom.llm import exactdup

SCHEMA = "doc_id long, text string, mark string, m long, data string"


def rows_of(seed: int) -> list[tuple]:
    rng, out = random.Random(seed), []
    for i in range(120):
        text = rng.choice(["ab", "é ü", "ünïcode", "", None, "x" * 50, "long " * 40, "LONG " * 40]) if i % 3 else f"own {i}"
        if text and rng.random() < 0.6:
            text = "".join(c + rng.choice(["", "", " ", "\n", "\t\x0b"]) for c in text)
        out.append((rng.choice([i, i, 7, None, -(2**63), 2**63 - 1]), text, "m", i, "d"))
    return out + out[:9]


def plain(rows: list[tuple]) -> list[tuple]:
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault("".join(c for c in r[1] or "" if c not in " \t\n\x0b\x0c\r"), []).append(r)
    out = []
    for text, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        out += [(r[0], best, len(own), r[0] == best, hashlib.sha256(text.encode()).hexdigest()) for r in own]
    return sorted(out, key=repr)


@pytest.mark.parametrize("prints", [exactdup.fingerprint, lambda data: (0, 0, len(data))], ids=["true", "colliding"])
@pytest.mark.parametrize(("seed", "huge"), [(1, exactdup.HUGE), (2, 7), (3, 60)])
def test_groups_as_in_plain_python(spark, prints, seed, huge):
    rows = rows_of(seed)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = exactdup.exact_duplicates(docs, prints, huge).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got], key=repr) == plain(rows)


def test_parts_of_huge_texts_have_the_whole_print(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcé \n") for _ in range(n)) for n in (101, 100, 999, 5000)]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, mark long, text string")
    for r in exactdup._prints_of_huge(docs, exactdup.fingerprint, 100).collect():
        data = exactdup.normal(texts[r["doc_id"]])
        assert (r["fp_a"], r["fp_b"], r["n_bytes"]) == exactdup.fingerprint(data) and r["text_sha256"] == hashlib.sha256(data).hexdigest() and r["n_points"] == len(texts[r["doc_id"]])


def test_empty_table(spark):
    assert exactdup.exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


class Batches:
    """Stands for a data frame; gives the function that a task runs."""

    def mapInArrow(self, run, shape):
        return run


@pytest.mark.parametrize("what", ["prints", "compared"])
def test_a_batch_is_not_held_again_as_python_objects(what):
    n, texts = 200, [f"{i} " * 20_000 for i in range(200)]
    if what == "prints":
        run = exactdup._prints_of(Batches(), exactdup.fingerprint)
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "mark": [0] * n, "text": texts})
    else:
        run = exactdup._compared(["fp_a", "fp_b", "n_bytes", "salt"], "rep", exactdup.COMPARED)
        numbers = {f.name: [0] * n for f in exactdup.COMPARED if f.name not in ("text_sha256", "data")}
        batch = pa.RecordBatch.from_pydict(numbers | {"fp_a": list(range(n)), "text_sha256": [""] * n, "data": [t.encode() for t in texts]})
    del texts
    tracemalloc.start()
    (out,) = run(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == n and peak < batch.nbytes / 4
    if what == "compared":
        assert out.column("data").to_pylist() == batch.column("data").to_pylist()
