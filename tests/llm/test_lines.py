"""Line dedup against the promise itself: every run of 49 words or more that occurs earlier goes, whatever stands around it."""

import random

import duckdb
import pytest

from sparkloom.llm import linededup

LEAST = linededup.GRAM + linededup.WINDOW - 1


def promised(texts: list[str]) -> list[list[str]]:
    """By brute force, the lines of each text that stay where runs of LEAST words or more that occur earlier go."""
    lines = [[x for x in t.split("\n") if x.split()] for t in texts]
    words = [[len(x.split()) for x in own] for own in lines]
    out = []
    for d, own in enumerate(lines):
        gone = set()
        for i in range(len(own)):
            for e in range(d + 1):
                for j in range(len(lines[e]) if e < d else i):
                    n = 0
                    while i + n < len(own) and j + n < len(lines[e]) and own[i + n] == lines[e][j + n]:
                        n += 1
                    if sum(words[d][i : i + n]) >= LEAST:
                        gone.update(range(i, i + n))
        out.append([x for i, x in enumerate(own) if i not in gone])
    return out


def corpus(rng: random.Random, size: int, blank: bool) -> list[str]:
    """Texts of shared parts in many combinations, so that what stands before and after a part differs from text to text."""
    line = lambda: " ".join(f"w{rng.randrange(10**8)}" for _ in range(rng.randrange(1, 2 * size)))
    parts = [[line() for _ in range(rng.randrange(1, 2 + 60 // size))] for _ in range(8)]
    out = []
    for _ in range(14):
        own = []
        for _ in range(rng.randrange(1, 5)):
            part = rng.choice(parts) if rng.random() < 0.8 else [line() for _ in range(3)]
            a = rng.randrange(len(part)) if rng.random() < 0.3 else 0
            own += part[a:] + ([""] * rng.randrange(3) if blank else [])
        out.append("\n".join(own))
    return out


def blanks_apart(texts: list[str]) -> list[tuple]:
    return [tuple(x for x in (t or "").split("\n") if x.split()) for t in texts]


@pytest.mark.parametrize(("seed", "size", "blank"), [(1, 9, False), (2, 1, False), (3, 4, True), (4, 14, True), (5, 25, False), (6, 2, True)])
def test_every_earlier_run_goes(spark, seed, size, blank):
    rng, rows, want = random.Random(seed), [], []
    for k in range(6):  # corpora apart from one another
        texts = corpus(rng, size, blank)
        rows += [(100 * k + i, t) for i, t in enumerate(texts)]
        want += promised(texts)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in linededup.line_report(docs).collect()}
    for (i, _), stays in zip(rows, want, strict=True):
        left = [x for x in out[i]["text"].split("\n") if x.split()]
        # A shorter run may go, too, if it holds a fingerprint; nothing that the promise covers may stay.
        rest = iter(stays)
        assert all(x in rest for x in left), i
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    sql = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, n_lines, n_deleted, text FROM ({linededup.ORACLE_SQL})").fetchall()}
    assert {i: (r["n_lines"], r["n_deleted"], r["text"]) for i, r in out.items()} == sql


def test_core_known_from_elsewhere(spark):
    """The core stands alone in the first text; the second and third have it with the same lines around it."""
    rng = random.Random(9)
    line = lambda n: " ".join(f"w{rng.randrange(10**8)}" for _ in range(n))
    rows, left = [], {}
    for k in range(40):
        a, c, b = ([line(6) for _ in range(4)] for _ in range(3))
        own = [[line(5)], [line(5), *a], [line(5), *a]]
        rows += [(10 * k, "\n".join([*own[0], *c])), (10 * k + 1, "\n".join([own[1][0], *a, *c, *b])), (10 * k + 2, "\n".join([own[2][0], *a, *c, *b]))]
        left[10 * k + 2] = own[2][0]
    out = {r["doc_id"]: r["text"] for r in linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == t for i, t in left.items())


def test_nothing_else_goes(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(" ".join(f"w{rng.randrange(10**8)}" for _ in range(8)) for _ in range(20)) + "\nshort shared line\n" * 3) for i in range(20)]
    out = linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_deleted"] == 0 for r in out) and {r["doc_id"]: r["text"] for r in out} == dict(rows)


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for part in (linededup.fingerprints(linededup.lines(docs.selectExpr("doc_id", "0L mark", "text"))), linededup.line_report(docs)):
        assert "Python" not in part._jdf.queryExecution().executedPlan().toString()
