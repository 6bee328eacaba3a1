"""Best-fit packing by patterns: non-negative least squares fits how often each pattern of up to three lengths is used.

Everything but the pieces themselves depends only on the histogram of lengths, which has at most `capacity` entries at
any size of the input; so the plan is made on the driver, and pieces find their place by length and rank.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import common, tokens
from sparkloom.llm.common import INT, LONG

CAPACITY = 2048
END_ID = 0
PIECES = common.schema(doc_id=LONG, piece=INT, start=LONG, length=LONG, ids_crc32=LONG)
PACKED = common.schema(**{f.name: f.dataType for f in PIECES}, sequence_id=LONG, offset=LONG)


def patterns(histogram: np.ndarray) -> np.ndarray:
    """All a <= b <= c with a + b + c = capacity among lengths that occur; c alone or b and c where the rest are 0."""
    top = len(histogram) - 1
    there = histogram > 0
    there[0] = True
    out = []
    for a in np.flatnonzero(there[: top // 3 + 1]):
        b = np.arange(a, (top - a) // 2 + 1)
        b = b[there[b] & there[top - a - b]]
        if a == 0 or len(b):
            out.append(np.column_stack([np.full(len(b), a), b, top - a - b]))
    found = np.concatenate(out)
    return found[(found[:, 0] == 0) | (found[:, 1] > 0)]


def fit(found: np.ndarray, histogram: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram| by accelerated projected gradients; column p of A counts pattern p's lengths."""
    size, want = len(histogram), histogram.astype(float)
    want[0] = 0

    def forward(x: np.ndarray) -> np.ndarray:
        h = sum(np.bincount(found[:, k], x, size) for k in range(3))
        h[0] = 0
        return h

    def back(r: np.ndarray) -> np.ndarray:
        return r[found[:, 0]] + r[found[:, 1]] + r[found[:, 2]]

    v = np.ones(len(found))
    for _ in range(12):  # the largest eigenvalue of A'A
        v = back(forward(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / max(np.linalg.norm(back(forward(v))) * 1.05, 1e-9)
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - want))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / after * (new - x), after
    return x


def plan(histogram: np.ndarray) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, count, first sequence, offset) that place every piece, and the number of sequences.

    Pieces of a length are taken by rank; the i-th of a row goes to the i-th sequence from its first. Fitted patterns
    are rounded so that running sums stay true, as far as pieces last; what is left is packed best fit, longest first.
    """
    left, capacity = histogram.astype(np.int64).copy(), len(histogram) - 1
    left[0] = 0
    rank, rows, sequence = np.zeros(capacity + 1, dtype=np.int64), [], 0

    def place(length: int, count: int, first: int, offset: int) -> None:
        rows.append((length, rank[length], count, first, offset))
        rank[length] += count
        left[length] -= count

    if left[capacity]:
        n = int(left[capacity])
        place(capacity, n, 0, 0)
        sequence += n
    if left.sum():
        found = patterns(left)
        if len(found):
            total = np.cumsum(fit(found, left))
            repeat = np.diff(np.floor(total + 0.5), prepend=0).astype(np.int64)
            for p in np.flatnonzero(repeat):
                uses = defaultdict(int)
                for length in found[p]:
                    if length:
                        uses[int(length)] += 1
                n = min([int(repeat[p]), *(int(left[k]) // m for k, m in uses.items())])
                if n > 0:
                    offset = 0
                    for length in found[p][::-1]:
                        if length:
                            place(int(length), n, sequence, offset)
                            offset += int(length)
                    sequence += n
    # Best fit on runs of open sequences, by the space that they have left.
    space: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 1, dtype=bool)
    for length in range(capacity, 0, -1):
        while left[length]:
            at = np.flatnonzero(filled[length:])
            if not len(at):
                n = int(left[length])
                first, fits, sequence = sequence, 1, sequence + n
                place(length, n, first, 0)
                room = capacity - length
            else:
                room = length + int(at[0])
                first, open_ = space[room].pop()
                filled[room] = bool(space[room])
                n = min(int(left[length]), open_)
                if n < open_:
                    space[room].append((first + n, open_ - n))
                    filled[room] = True
                place(length, n, first, capacity - room)
                room -= length
            if room:
                space[room].append((first, n))
                filled[room] = True
    return np.array(rows, dtype=np.int64).reshape(-1, 5), sequence


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Documents as pieces of at most `capacity` tokens; only the first of a cut document may be shorter."""

    def cutting():
        encoder = tokens.encoder(tokenizer, True, "<u4")
        end = np.array([end_id], dtype="<u4").tobytes()

        def each(names: list, texts: list) -> Iterator[dict]:
            for a, z in tokens.in_slices(texts):
                docs, numbers, starts, lengths, sums = [], [], [], [], []
                for doc, ids in zip(names[a:z], encoder.encode(texts[a:z]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    start, to, piece = 0, n - (n - 1) // capacity * capacity, 0
                    while start < n:
                        docs.append(doc)
                        numbers.append(piece)
                        starts.append(start)
                        lengths.append(to - start)
                        sums.append(zlib.crc32(memoryview(ids)[4 * start : 4 * to]))
                        start, to, piece = to, to + capacity, piece + 1
                yield {"doc_id": docs, "piece": numbers, "start": starts, "length": lengths, "ids_crc32": sums}

        return each

    return common.over_texts(docs, cutting, PIECES)


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (stored ones: they are read twice)."""
    counts = cut.groupBy("length").count().collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts:
        histogram[length] = n
    rows, _ = plan(histogram)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    slices = int(max(64, histogram.sum() // 50_000))
    keyed = cut.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)).cast("int"))
    sums = keyed.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = keyed.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(sums.select("length", "_slice", before.alias("_before")), ["length", "_slice"])
    ranked = ranked.select(*cut.columns, (F.col("_before") + F.col("_row") - 1).alias("_rank"))
    top = int(rows[:, 1].max() + 1) if len(rows) else 1
    starts = rows[:, 0] * top + rows[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            row = rows[np.searchsorted(starts, length * top + rank, "right") - 1]
            own = [batch.column(batch.schema.get_field_index(c)) for c in PIECES.names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=PACKED.names)

    return ranked.mapInArrow(place, PACKED)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A null or empty text is its end id alone; a row with a null doc_id is packed under null; repeated rows are packed
    each; an empty table gives no rows; further columns are ignored. Within a sequence pieces follow without a gap.
    """
    return packed(common.stored(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
