"""Periodic runs of words, found by multi-scale minimizers.

A run is a stretch of words with smallest period q (words q apart are equal) and at
least max(6, 4 q) words that no neighbouring word extends. Words are runs of
characters other than ASCII white space, compared as they are.

Periods up to `SHORT` come from direct lag scans: stretches of positions whose word
equals the one q further on. Longer periods go by scales. The scale Q looks for periods
in (Q/2, Q]: every Q words in a row get a hash (the hashes of scale Q combine two of
scale Q/2), and each window of Q/2 of them gives its least, leftmost first. In a
run of such a period, windows one period apart lie inside the run and read the same
hashes, so their minima are equal and one period apart; between them the run has no
equal Q words, as that would make its period smaller. So it is enough to follow
each chosen place to the next chosen place of the same hash. Such a pair is a seed;
it is extended over the words themselves, and what is long enough is a run. A
multiple of the smallest period gives the same stretch and is dropped. Work grows
with n log n of a text, and with the stretches found.

Texts are taken together, some megabytes at a time, with a word of its own between
them. Null, empty and blank texts have no words and no runs. Rows are
independent: repeated rows, ties and null ids give a row each, and an empty table none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .base import whole

SHORT = 8
LEAST = 6
POWER = 4
BYTES_AT_ONCE = 4 << 20
ROWS_AT_ONCE = 2000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xC2B2AE3D27D4EB4F)


def least_length(period: int) -> int:
    return max(LEAST, POWER * period)


def _mixed(values: np.ndarray) -> np.ndarray:
    out = values * _MIX
    out ^= out >> np.uint64(32)
    out *= _FOLD
    out ^= out >> np.uint64(29)
    return out


def lag_stretches(ids: np.ndarray, period: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the maximal stretches of this lag that are long enough."""
    same = np.flatnonzero(ids[period:] == ids[:-period])
    if not len(same):
        return
    cuts = np.flatnonzero(np.diff(same) != 1)
    first = same[np.concatenate([[0], cuts + 1])]
    last = same[np.concatenate([cuts, [len(same) - 1]])]
    long = last - first + 1 + period >= least_length(period)
    yield from zip(first[long].tolist(), (last[long] + 1 + period).tolist())


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct places of the least hash, leftmost first, of every `width` (a power of two) in a row."""
    least, place, reach = hashes, np.arange(len(hashes)), 1
    while reach < width:
        right = least[reach:] < least[:-reach]
        place = np.where(right, place[reach:], place[:-reach])
        least = np.where(right, least[reach:], least[:-reach])
        reach *= 2
    return np.unique(place)


def seeds(hashes: np.ndarray, width: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of chosen places and the next chosen place with the same hash, low < distance <= high."""
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chosen = window_minima(hashes, width)
    order = np.argsort(hashes[chosen], kind="stable")
    at, held = chosen[order], hashes[chosen][order]
    apart = at[1:] - at[:-1]
    near = (held[1:] == held[:-1]) & (apart > low) & (apart <= high)
    return at[:-1][near], apart[near]


def _reach(ids: np.ndarray, at: int, lag: int, step: int, limit: int) -> int:
    """How many places from `at` on (in direction `step`) match the word `lag` further on."""
    done, size = 0, 64
    while done < limit:
        size = min(2 * size, limit - done)
        a = at + step * done
        left = ids[a:a + size] if step > 0 else ids[a - size + 1:a + 1][::-1]
        right = ids[a + lag:a + lag + size] if step > 0 else ids[a + lag - size + 1:a + lag + 1][::-1]
        differ = left != right
        stop = int(differ.argmax())
        if differ[stop]:
            return done + stop
        done += size
    return done


def find_runs(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of the texts that lie at [begin, end) of `ids`.

    The word after each text must occur nowhere else.
    """
    found: dict[tuple[int, int], int] = {}
    longest = int((ends - begins).max(initial=0))
    for q in range(1, min(SHORT, longest // POWER, len(ids) - 1) + 1):
        for run in lag_stretches(ids, q):
            found.setdefault(run, q)
    scale = 2 * SHORT
    while longest >= least_length(scale // 2 + 1):
        # Only texts that can hold a run of this scale, with the word after them.
        wide = np.flatnonzero(ends - begins >= least_length(scale // 2 + 1))
        places = np.concatenate([np.arange(begins[t], ends[t] + 1) for t in wide])
        own = ids[places]
        hashes, reach = _mixed(own), 1
        while reach < scale and len(hashes) > reach:
            hashes = _mixed(hashes[:-reach] + _mixed(hashes[reach:]))
            reach *= 2
        done: dict[int, int] = {}  # up to where a period's matches are known
        at, lag = seeds(hashes, scale // 2, scale // 2, scale) if reach == scale else ([], [])
        order = np.argsort(at, kind="stable")
        for m, q in zip(np.asarray(at)[order].tolist(), np.asarray(lag)[order].tolist()):
            if m < done.get(q, 0):
                continue
            after = _reach(own, m, q, 1, len(own) - q - m)
            before = _reach(own, m - 1, q, -1, m) if m else 0
            done[q] = m + max(after, 1)
            if before + after + q >= least_length(q):
                run = (int(places[m - before]), int(places[m + after - 1]) + 1 + q)
                found[run] = min(q, found.get(run, q))
        scale *= 2
    return sorted((s, e, q) for (s, e), q in found.items())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of few bytes of text (at least one row)."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            upto = int(np.searchsorted(sizes, before + BYTES_AT_ONCE, side="right"))
            n = min(ROWS_AT_ONCE, max(1, upto - at))
            yield batch.slice(at, n)
            at += n


_FOUND = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                    ("collapsed", pa.string())])


def runs_of(texts: list[str | None]) -> tuple[list[int], list[list[dict]], list[str]]:
    """Number of words, runs and the collapsed text of each text."""
    known: dict[bytes, int] = {}
    words = [(t or "").encode().split() for t in texts]
    size = sum(map(len, words)) + len(words)
    ids = np.empty(size, np.int64)
    begins, ends, at = np.empty(len(words), np.int64), np.empty(len(words), np.int64), 0
    for k, held in enumerate(words):
        begins[k], ends[k] = at, at + len(held)
        ids[at:at + len(held)] = [known.setdefault(w, len(known)) for w in held]
        at += len(held) + 1
    ids[ends] = -1 - np.arange(len(words))
    hashed = ids.astype(np.uint64)
    runs: list[list[dict]] = [[] for _ in words]
    drop: dict[int, np.ndarray] = {}
    for s, e, q in find_runs(hashed, begins, ends):
        k = int(np.searchsorted(begins, s, side="right")) - 1
        s, e = s - int(begins[k]), e - int(begins[k])
        runs[k].append({"start": s, "length": e - s, "period": q})
        drop.setdefault(k, np.zeros(len(words[k]), bool))[s + q:e] = True
    left = [b" ".join(w if k not in drop else [x for x, gone in zip(w, drop[k].tolist()) if not gone]).decode() for k, w in enumerate(words)]
    return [len(w) for w in words], runs, left


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, n_words, `runs` (start, length, period; by start, then period) and `collapsed` of every row.

    `collapsed` has the words, joined by one blank, without those that a run repeats after
    its first period.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            n, runs, left = runs_of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(runs, _FOUND.field("runs").type), pa.array(left, pa.string())],
                                             names=[key, "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`"), whole(F.col(f"`{text}`")).alias("text"))
    return rows.mapInArrow(find, f"`{key}` {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def longest_run(runs: Column) -> Column:
    """The run of greatest length, then of smallest start and period; null if there is none."""
    return F.get(F.array_sort(F.transform(runs, lambda r: F.struct(
        F.negative(r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(0))


def run_lines(runs: Column) -> Column:
    """`start,length,period` and a line feed for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")


def planted(text: Column, doc_id: Column) -> Column:
    """The text; where crc32 of the id ends in 0, its words with a period planted by the rest of that number.

    From word a = g % n on, the words repeat with period 1 + floor((n - a) / (3 + g % 8)), g being the
    crc32 divided by ten. Texts without words or id stay as they are.
    """
    h = F.crc32(doc_id.cast("string"))

    def edited(x: Column) -> Column:
        n = F.size(x["w"]).cast("bigint")
        a = x["g"] % n
        p = 1 + F.floor((n - a) / (3 + x["g"] % 8))
        at = F.sequence(F.lit(0).cast("bigint"), n - 1)
        picked = F.transform(at, lambda i: F.get(x["w"], F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(picked, " ")).otherwise(F.lit(""))

    # The words are computed once, as an element that the lambda names.
    split = F.struct(F.regexp_extract_all(whole(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"), F.floor(h / 10).alias("g"))
    return F.when(h % 10 == 0, F.element_at(F.transform(F.array(split), edited), 1)).otherwise(whole(text))
