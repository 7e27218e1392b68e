"""Best-fit packing of documents into sequences by exact-complement hashing.

Documents of equal length are interchangeable, so the combinations are found on the
histogram of piece lengths: at most `capacity` counts, whatever the number of
documents. For the longest length left, the single, pair or triple of lengths that
fills the gap exactly is looked up among the lengths still available, and
consumed as often as all its members allow. What has no exact complement is filled
best-fit. The plan (ranges of ranks within a length -> sequence and offset) is
applied to the pieces in parallel.

Null and empty texts hold just the end id. Repeated rows are packed as often as
they occur. An empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import lookup_side, settle
from .base import END_ID, WordIds, slices, whole

CAPACITY = 4096


def complement(gap: int, left: np.ndarray, largest: int) -> tuple[int, ...] | None:
    """One, two or three available lengths, none over `largest`, that sum to the gap; larger ones first."""
    if gap <= largest and left[gap]:
        return (gap,)
    have = np.flatnonzero(left[:min(gap, largest + 1)])
    pairs = have[(have * 2 >= gap)]
    other = gap - pairs
    fits = (left[other] > 0) & ((other != pairs) | (left[pairs] > 1))
    if fits.any():
        a = int(pairs[fits][-1])
        return (a, gap - a)
    for a in have[have * 3 >= gap][::-1].tolist():
        rest = gap - a
        second = have[(have * 2 >= rest) & (have <= a) & (have < rest)]
        third = rest - second
        need = 1 + (second == a) + (third == a)
        fits = (left[third] > 0) & (left[second] >= 1 + (third == second)) & (left[a] >= need)
        if fits.any():
            b = int(second[fits][-1])
            return (a, b, rest - b)
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences), covering all counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plans = []

    def use(pattern: tuple[int, ...]) -> None:
        kinds, each = np.unique(pattern, return_counts=True)
        times = int((left[kinds] // each).min())
        left[kinds] -= times * each
        plans.append((pattern, times))

    for top in range(capacity, 0, -1):
        while left[top]:
            if top == capacity:
                use((top,))
                continue
            left[top] -= 1  # its own place is taken while its complement is sought
            found = complement(capacity - top, left, top)
            left[top] += 1
            if found:
                use((top, *found))
                continue
            pattern, room = [top], capacity - top
            left[top] -= 1
            while room:
                fitting = np.flatnonzero(left[:room + 1])
                if not len(fitting):
                    break
                best = int(fitting[-1])
                pattern.append(best)
                left[best] -= 1
                room -= best
                last = complement(room, left, top) if room else None
                if last:
                    pattern += last
                    for x in last:
                        left[x] -= 1
                    break
            for x in pattern:
                left[x] += 1
            use(tuple(pattern))
    return plans


def segments(plans: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted arrays: key (length and first rank), first sequence, offset."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plans:
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            rows.append((length, rank, sequence - rank, offset))
            taken[length] = rank + times
            offset += length
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return (columns[0] << 48) + columns[1], columns[2], columns[3]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of at most `capacity`, with their place among equal lengths of the task."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()),
                        ("ids", pa.binary()), ("part", pa.int32()), ("nth", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, part = WordIds(tokenizer), struct.pack("<I", END_ID), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in slices(batches):
            out = [[] for _ in schema]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at:at + 4 * capacity]
                    length = len(own) // 4
                    for column, value in zip(out, (doc_id, piece, at // 4, length, own, part, seen[length])):
                        column.append(value)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole(F.col("text")).alias("text"))
    return rows.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length int, ids binary, part int, nth bigint")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of every piece."""
    cut = settle(pieces(docs, tokenizer, capacity))
    counted = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n")
    bases = lookup_side(bases)
    # At most `capacity` rows.
    counts = {r.length: r.n for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    keys, sequences, offsets = segments(plan(counts, capacity))

    @F.pandas_udf("sequence_id bigint, offset int")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (length.to_numpy(np.int64) << 48) + rank.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + rank.to_numpy(np.int64), "offset": offsets[at].astype(np.int32)})

    ranked = cut.join(bases.select("length", "part", "base"), ["length", "part"])
    return ranked.withColumn("at", place("length", F.col("base") + F.col("nth"))).select(
        "doc_id", "piece", "start", "length", "ids", "at.sequence_id", "at.offset")
