"""Near-duplicates against brute force: repeated ids, ties, groups without their origin, and blocks that are too small."""

import random

import pytest

from sparkloom.llm import neardup


def shingle_set(text: str | None) -> frozenset:
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows: list[tuple]) -> dict:
    """doc_id to least doc_id reachable; rows that share an id are one document."""
    sets: dict[frozenset, set] = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(shingle_set(t), set()).add(d)
    root = {d: d for d, _ in rows if d is not None}

    def join(ids: set) -> None:
        old = {root[i] for i in ids}
        for i in root:
            if root[i] in old:
                root[i] = min(old)

    known = [s for s in sets if s]
    for i, a in enumerate(known):
        join(sets[a])
        for b in known[:i]:
            if 100 * len(a & b) >= 75 * len(a | b):
                join(sets[a] | sets[b])
    return root


def corpus(rng: random.Random) -> list[tuple]:
    rows = []
    for _ in range(12):
        base = [f"b{rng.randrange(10**6)}" for _ in range(rng.choice([3, 5, 30, 120, 200]))]
        for _ in range(rng.choice([1, 2, 12])):  # edited copies; the base itself is not among them
            w = list(base)
            for at in rng.sample(range(len(w)), min(len(w), rng.choice([0, 1, 2, 4]))):
                w[at] = f"e{rng.randrange(10**6)}"
            rows.append((rng.randrange(60) if rng.random() < 0.5 else 100 + len(rows), " ".join(w).title() if rng.random() < 0.3 else "\n ".join(w)))
    word = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows += [(1005, word("a")), (1005, word("b")), (1007, word("b") + " more"), (1008, word("a") + " more"), (1009, word("c"))]  # two texts under one id
    large = [f"g{i}" for i in range(150)]
    for i in range(200):
        w = list(large)
        for at in rng.sample(range(150), rng.choice([2, 3, 4, 5])):
            w[at] = f"e{i}-{at}"
        rows.append((2000 + i, " ".join(w)))
    return [*rows, *rows[:5], (None, "lost"), (None, rows[0][1]), (1, None), (2, ""), (3, " \t"), (rows[3][0], "")]


@pytest.mark.parametrize("seed", [1, 3])
def test_components_with_repeated_ids(spark, seed, monkeypatch):
    if seed > 2:  # many blocks
        monkeypatch.setattr(neardup, "BLOCK", 2)
        monkeypatch.setattr(neardup, "SET_BLOCK", 100)
    rows = corpus(random.Random(seed))
    out = neardup.near_duplicates(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, label int")).collect()
    want = brute(rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"]) for r in out) == sorted((d if d is not None else -1, len(shingle_set(t))) for d, t in rows)
    assert [want[i] for i in (1005, 1007, 1008, 1009)] == [1005, 1005, 1005, 1009]
    for r in out:
        assert (r["component_id"], r["kept"]) == ((None, True) if r["doc_id"] is None else (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"]))


def test_kept_rows_have_their_own_columns(spark):
    word = " ".join(f"a{i}" for i in range(60))
    rows = [(2, word, "x", 1), (1, word, "y", 2), (3, "alone", "z", 3), (None, word, "w", 4)]
    kept = neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string, component_id string, n_shingles long")).collect()
    assert sorted(tuple(r)[2:] for r in kept) == [("w", 4), ("y", 2), ("z", 3)]
