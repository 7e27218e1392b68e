"""Near-duplicates by an LSH forest over MinHash signatures.

Every set of word shingles gets 128 minima. Each of 16 trees orders the sets by its
own sequence of 8 minima; in that order, sets with long common prefixes stand
together. A run of sets that share the least depth is compared whole up to `NEAR` sets.
Beyond, a set meets only the neighbours just before it, which share the longest
prefix with it, and the first set of its run at three depths. The least depth is the largest that
some tree shows for all but about 1 in 100,000 links of the asked similarity
(4 for 0.85, 3 for 0.8); the components join what further neighbours link.

Crowded runs whose sets are not all in one component by then are gone through again.
A hub, the set nearest to the majority of the run's bits, meets every set
of another component, as often as that links more. What is then outside the hub's component is
told apart by its differences from the hub: two sets that share c and d elements with it
have at most min(c, d) common elements there, so a link needs either a shared element
that the hub lacks, or sizes so close to these counts that no other is needed. The first are met by
the rarest such elements (as many as the missing common elements leave), the second by size. So
every pair that shares the least depth is compared, excluded by its differences, or in one
component already, and no run's pairs are ever listed.

Candidates of hopeless size ratio or estimate are dropped, and every link is
confirmed on the full sets. Equal sets are one class from the start. Confirmation
goes in two rounds: each class's best partner first, then only pairs that the
links found do not connect yet.

Rows without words have an empty set and no links; rows without an id take no
part: their component is null and they are kept. Rows that share an id and a text are one
document; rows that share an id only are linked through it. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import lookup_side, settle
from .base import Rounds, WordHashes, slices
from .components import components

MINIMA = 128
TREES = 16
DEPTH = 8
MISSED = 1.1e-5
NEAR = 16
CLOSE = 2
HUBS = 6  # hub rounds at most; what they leave open is compared pair by pair

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def bits_agree(percent: int) -> int:
    """Of the 128 lowest bits those that agree in all but about one in a million links: five deviations below the mean."""
    s = percent / 100
    return int(64 * (1 + s) - 5 * (32 * (1 - s * s)) ** 0.5)


def least_depth(percent: int) -> int:
    fits = [d for d in range(1, DEPTH + 1) if (1 - (percent / 100) ** d) ** TREES <= MISSED]
    return max(fits, default=1)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words are one shingle."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    held = np.full(n, width, np.uint64)
    for k in range(width):
        held = (held + words[k:k + n]) * _MIX[k % 3]
        held ^= held >> np.uint64(29 + k % 3)
    return np.unique(held)


def _multipliers() -> np.ndarray:
    drawn = np.random.default_rng(20_240_601).integers(0, 1 << 63, MINIMA, dtype=np.uint64)
    return (drawn * np.uint64(2) + np.uint64(1))[:, None]


def minima(held: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(held), 4096):
        part = (multipliers * held[None, at:at + 4096]) >> np.uint64(32)
        least = np.minimum(least, part.min(1).astype(np.uint32))
    return least


def tree_orders() -> np.ndarray:
    """Which minima each tree reads, in order: two passes over all 128, each in an order of its own."""
    rng = np.random.default_rng(7)
    passes = -(-TREES * DEPTH // MINIMA)
    return np.concatenate([rng.permutation(MINIMA) for _ in range(passes)])[:TREES * DEPTH].reshape(TREES, DEPTH)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), two hashes of the whole set, and the minima as bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("minima", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash


        hashes, multipliers = WordHashes(), _multipliers()
        for batch in slices(batches):
            out = [[] for _ in schema]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = shingles(hashes.of(text), width)
                h1, h2 = np.frombuffer(xxhash.xxh3_128_digest(held.tobytes()), "<i8").tolist()
                signed = minima(held, multipliers).tobytes() if len(held) else None
                for column, value in zip(out, (doc_id, len(held), h1, h2, signed)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sign, "doc_id bigint, n bigint, h1 bigint, h2 bigint, minima binary")


_PLACED = pa.schema([("key", pa.binary()), ("rep", pa.int64()), ("n", pa.int64()), ("b0", pa.int64()), ("b1", pa.int64())])
_PAIRS = "a bigint, b bigint, agree int"
_CROWDED = -2  # in place of the number of an edge, which is -1 or more


def _table(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = np.packbits(sig & 1, axis=1).view("<i8")
    return bits[:, 0], bits[:, 1]


def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class and tree; the key is the tree and its minima, big-endian."""
    orders = tree_orders()
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, MINIMA)
        b0, b1 = _table(sig)
        for tree, order in enumerate(orders):
            body = np.ascontiguousarray(sig[:, order].astype(">u4")).view(np.uint8)
            keys = np.concatenate([np.full((len(sig), 1), tree, np.uint8), body], axis=1)
            wide = keys.shape[1]
            offsets = np.arange(len(sig) + 1, dtype=np.int32) * wide
            yield pa.RecordBatch.from_arrays([
                pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(keys.tobytes())]),
                batch.column(0), batch.column(1), pa.array(b0), pa.array(b1)], schema=_PLACED)


def _agreement(a: tuple, b: tuple) -> np.ndarray:
    differ = [np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int32) for x, y in zip(a, b)]
    return 128 - differ[0] - differ[1]


class Walk:
    """Goes along a sorted order, keeping the last rows and the first row of each run."""

    def __init__(self, percent: int):
        self.percent, self.least, self.bits, self.kept = percent, least_depth(percent), bits_agree(percent), None
        self.leaders: dict[int, tuple] = {}
        self.crowded: list[bytes] = []  # prefixes of runs seen beyond NEAR in the last step

    def step(self, keys: np.ndarray, rep, n, b0, b1):
        """Candidate pairs whose later row is among these."""
        own = (keys, rep, n, b0, b1)
        joined = own if self.kept is None else tuple(np.concatenate(x) for x in zip(self.kept, own))
        first = len(joined[1]) - len(rep)
        words = joined[0]
        same = np.zeros((len(words), DEPTH + 1), bool)  # same[i, d]: row i shares tree and d minima with row i - 1
        if len(words) > 1:
            equal = np.logical_and.accumulate(words[1:] == words[:-1], axis=1)
            for d in range(self.least, DEPTH + 1):
                same[1:, d] = equal[:, 4 * d]
        rows, others = [], []
        place = np.arange(len(words))
        early = place - np.maximum.accumulate(np.where(same[:, self.least], 0, place)) < NEAR
        late = words[np.flatnonzero(same[:, self.least] & ~early), :1 + 4 * self.least]
        self.crowded = [p.tobytes() for p in np.unique(late, axis=0)] if len(late) else []
        run = same[:, self.least].copy()  # row i shares the prefix with each of the `back` rows before it
        for back in range(1, NEAR + 1):
            if back > 1:
                run[back - 1:] &= same[:len(words) - back + 1, self.least]
            at = np.flatnonzero(run & early if back > CLOSE else run)
            at = at[at >= first]
            if not len(at):
                break
            rows.append(at)
            others.append(at - back)
        found = [self._pairs(joined, np.concatenate(rows), tuple(c[np.concatenate(others)] for c in joined[1:]))] if rows else []
        for d in sorted({self.least, (self.least + DEPTH) // 2, DEPTH}):
            starts = np.where(same[:, d], 0, np.arange(len(words)))
            starts = np.maximum.accumulate(starts)
            at = np.arange(first, len(words))
            begun = starts[at] > 0 if self.kept is not None else np.ones(len(at), bool)
            lead = [c[starts[at]] for c in joined[1:]]
            if self.kept is not None and d in self.leaders:
                for c, value in zip(lead, self.leaders[d]):
                    c[~begun] = value
            far = lead[0] != joined[1][at]
            if far.any():
                found.append(self._pairs(joined, at[far], tuple(c[far] for c in lead)))
            last = starts[-1]
            if last > 0 or self.kept is None:
                self.leaders[d] = tuple(c[last] for c in joined[1:])
        self.kept = tuple(c[-NEAR:] for c in joined)
        return found

    def _pairs(self, joined, at, other):
        rep, n, b0, b1 = (c[at] for c in joined[1:])
        agree = _agreement((b0, b1), (other[2], other[3]))
        keep = (100 * np.minimum(n, other[1]) >= self.percent * np.maximum(n, other[1])) & (agree >= self.bits) & (rep != other[0])
        return np.minimum(rep, other[0])[keep], np.maximum(rep, other[0])[keep], agree[keep].astype(np.int32)


def _columns(batch: pa.RecordBatch):
    keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, 1 + 4 * DEPTH)
    return keys, *[batch.column(i).to_numpy() for i in range(1, 5)]


def candidates(placed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs (a < b) with the number of agreeing bits, and the prefixes of crowded runs."""
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs, edge_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("agree", pa.int32()), ("edge", pa.int32()), *_PLACED]), \
        f"{_PAIRS}, edge int, key binary, rep bigint, n bigint, b0 bigint, b1 bigint"

    def found_rows(found):
        for a, b, agree in found:
            if len(a):
                none = [pa.nulls(len(a), t) for t in (pa.int32(), *_PLACED.types)]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(agree), *none], schema=pairs)

    def edge_rows(rows, edge):
        keys, *rest = rows
        none = [pa.nulls(len(keys), t) for t in (pa.int64(), pa.int64(), pa.int32())]
        return pa.RecordBatch.from_arrays([
            *none, pa.array(np.full(len(keys), edge, np.int32)), pa.array([k.tobytes() for k in keys], pa.binary()), *map(pa.array, rest)], schema=pairs)

    def crowd_rows(prefixes):
        none = [[pa.nulls(len(prefixes), t) for t in kinds] for kinds in ((pa.int64(), pa.int64(), pa.int32()), _PLACED.types[1:])]
        return pa.RecordBatch.from_arrays([
            *none[0], pa.array(np.full(len(prefixes), _CROWDED, np.int32)), pa.array(prefixes, pa.binary()), *none[1]], schema=pairs)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, along = TaskContext.get().partitionId(), None, Walk(percent)
        for batch in batches:
            if batch.num_rows:
                rows = _columns(batch)
                if head is None or len(head[1]) < NEAR:
                    head = tuple(c[:NEAR] for c in rows) if head is None else tuple(np.concatenate(x)[:NEAR] for x in zip(head, rows))
                yield from found_rows(along.step(*rows))
                if along.crowded:
                    yield crowd_rows(along.crowded)
        if head is not None:
            yield edge_rows(head, part - 1)
            yield edge_rows(along.kept, part)

    def mend(frame: pd.DataFrame) -> pd.DataFrame:
        """Pairs over the border between two parts of the order."""
        frame = frame.sort_values(["key", "rep"])
        keys = np.frombuffer(b"".join(frame["key"]), np.uint8).reshape(len(frame), 1 + 4 * DEPTH)
        along = Walk(percent)
        found = along.step(keys, *[frame[c].to_numpy() for c in ("rep", "n", "b0", "b1")])
        out = [pd.DataFrame({"a": a, "b": b, "agree": g}) for a, b, g in found] + [pd.DataFrame({"key": along.crowded})]
        return pd.concat(out).reindex(columns=["a", "b", "agree", "key"]).astype({"a": "Int64", "b": "Int64", "agree": "Int32"})

    ordered = placed.repartitionByRange(n, "key", "rep").sortWithinPartitions("key", "rep")
    walked = settle(ordered.mapInArrow(walk, edge_schema))
    inside = walked.where("edge IS NULL").select("a", "b", "agree")
    over = settle(walked.where(F.col("edge") > _CROWDED).groupBy("edge").applyInPandas(mend, f"{_PAIRS}, key binary"))
    crowded = walked.where(F.col("edge") == _CROWDED).select("key").unionByName(over.where("key IS NOT NULL").select("key"))
    found = inside.unionByName(over.where("key IS NULL").drop("key")).groupBy("a", "b").agg(F.max("agree").alias("agree"))
    return found, crowded.distinct()


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of the full sets."""
    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.zeros(len(left), bool)
        for i, (x, y) in enumerate(zip(left, right)):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([a, b])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            out[i] = 100 * shared >= percent * (len(both) - shared)
        return pd.Series(out)

    one = pairs.join(sets.select(F.col("rep").alias("a"), F.col("held").alias("left")), "a")
    two = one.join(sets.select(F.col("rep").alias("b"), F.col("held").alias("right")), "b")
    return two.where(linked("left", "right")).select("a", "b")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, held): the whole shingle set of each wanted class (rep, h1, h2)."""
    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash


        hashes = WordHashes()
        for batch in slices(batches):
            held = [shingles(hashes.of(t), width).tobytes() for t in batch.column(1).to_pylist()]
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h) for h in held), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(held, pa.binary())],
                                             names=["rep", "h1", "h2", "held"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("rep"), F.col("text").cast("string").alias("text"))
    near = rows.join(lookup_side(wanted.select("rep").distinct(), 16), "rep", "left_semi").select("rep", "text")
    sets = near.mapInArrow(hold, "rep bigint, h1 bigint, h2 bigint, held binary")
    return settle(sets.join(wanted, ["rep", "h1", "h2"]).select("rep", "held").dropDuplicates(["rep"]))


def _agree(one: str, other: str) -> Column:
    differ = [F.bit_count(F.col(f"{one}.{b}").bitwiseXOR(F.col(f"{other}.{b}"))) for b in ("b0", "b1")]
    return (128 - differ[0] - differ[1]).cast("int")


def _meet(crowd: DataFrame, few: DataFrame, percent: int) -> DataFrame:
    """Pairs of a set of the crowd and one of the few in the same run that may be links of two components."""
    near = (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & (_agree("x", "y") >= bits_agree(percent))
    met = crowd.alias("x").join(lookup_side(few, 64).alias("y"), (F.col("x.run") == F.col("y.run")) & (F.col("x.comp") != F.col("y.comp")) & near)
    first = F.col("x.rep") < F.col("y.rep")
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"), _agree("x", "y").alias("agree"),
                      F.when(first, F.col("x.comp")).otherwise(F.col("y.comp")).alias("comp_a"),
                      F.when(first, F.col("y.comp")).otherwise(F.col("x.comp")).alias("comp_b")).dropDuplicates(["a", "b"])


def _hubs(crowd: DataFrame) -> DataFrame:
    """Of each run the set that agrees most with the majority of its bits."""
    ones = [F.sum(F.shiftrightunsigned(b, k).bitwiseAND(F.lit(1))).alias(f"{b}_{k}") for b in ("b0", "b1") for k in range(64)]
    counts = crowd.groupBy("run").agg(F.count("*").alias("m"), *ones)

    def major(b: str) -> Column:
        bits = F.array(*[F.when(2 * F.col(f"{b}_{k}") > F.col("m"), F.lit(1 << k if k < 63 else -1 << 63)).otherwise(F.lit(0)).cast("bigint") for k in range(64)])
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda x, y: x.bitwiseOR(y)).alias(b)

    majority = lookup_side(counts.select("run", major("b0"), major("b1")), 40).alias("y")
    best = crowd.alias("x").join(majority, F.col("x.run") == F.col("y.run")).groupBy("x.run").agg(
        F.max_by(F.struct("x.rep", "x.n", "x.b0", "x.b1", "x.comp"), F.struct(_agree("x", "y"), F.negative("x.rep"))).alias("h"))
    return best.select("run", "h.*")


def _outside(crowd: DataFrame) -> DataFrame:
    """The sets that are not in their run's largest component."""
    sizes = crowd.groupBy("run", "comp").count()
    largest = sizes.groupBy("run").agg(F.max_by("comp", F.struct("count", F.negative("comp"))).alias("comp"))
    return crowd.join(lookup_side(largest, 24), ["run", "comp"], "left_anti")


def _differences(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """hub, nh, hub_comp, rep, n, comp, c (elements shared with the hub) and extra (those it lacks)."""
    hubs = settle(_hubs(crowd).select("run", F.col("rep").alias("hub"), F.col("n").alias("nh"), F.col("comp").alias("hub_comp")))
    members = crowd.join(lookup_side(hubs), "run").select("hub", "nh", "hub_comp", "rep", "n", "comp").distinct()
    hub_sets = lookup_side(sets.join(lookup_side(hubs.select("hub").distinct(), 16), F.col("rep") == F.col("hub"), "left_semi").select(
        F.col("rep").alias("hub"), F.col("held").alias("hub_held")))

    @F.pandas_udf("c bigint, extra array<bigint>")
    def beside(held: pd.Series, hub: pd.Series) -> pd.DataFrame:
        out = []
        for x, h in zip(held, hub):
            own, other = np.frombuffer(x, np.uint64), np.frombuffer(h, np.uint64)
            at = np.minimum(np.searchsorted(other, own), len(other) - 1)
            extra = own[other[at] != own]
            out.append((len(own) - len(extra), extra.view(np.int64).tolist()))
        return pd.DataFrame(out, columns=["c", "extra"])

    both = members.join(sets, "rep").join(hub_sets, "hub").withColumn("d", beside("held", "hub_held"))
    return settle(both.select("hub", "nh", "hub_comp", "rep", "n", "comp", "d.c", "d.extra"))


def _by_differences(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of two components of the crowd that may be links; see the head of this module."""
    told = _differences(crowd, sets)
    joins = 100 * F.col("c") >= percent * (F.col("n") + F.col("nh") - F.col("c"))
    hub_links = told.where(joins & (F.col("comp") != F.col("hub_comp"))).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    told = told.withColumn("comp", F.when(joins, F.col("hub_comp")).otherwise(F.col("comp")))
    # A link's other set has at least percent n elements, so this many common ones are beyond the hub.
    beyond = F.greatest(F.lit(1), F.ceil(percent * F.col("n") / 100) - F.col("c"))
    each = told.where(F.size("extra") >= beyond).select("hub", "rep", "n", "comp", (F.size("extra") - beyond + 1).alias("met"), F.size("extra").alias("extras"), F.explode("extra").alias("e"))
    held = each.groupBy("hub", "e", "comp").count().groupBy("hub", "e").agg(
        F.sum("count").alias("held"), F.max_by("comp", F.struct("count", F.negative("comp"))).alias("most"), F.count("*").alias("comps"))
    # Elements of one component only fill the first places and meet nothing: they need no row, just their number.
    own = Window.partitionBy("hub", "rep")
    placed = each.join(held.where("comps > 1").drop("comps"), ["hub", "e"]).withColumn(
        "rank", F.col("extras") - F.count("*").over(own) + F.row_number().over(own.orderBy("held", "e")))
    first = settle(placed.where(F.col("rank") <= F.col("met")).select("hub", "e", "rep", "n", "comp", "most"))
    ratio = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    # Of two components that share an element, one is not its largest.
    shared = first.where("comp != most").alias("x").join(first.alias("y"), ["hub", "e"]).where(ratio & (F.col("x.comp") != F.col("y.comp")))
    # Without such elements: sizes up to what the shared counts allow.
    most = F.floor((100 + percent) * F.col("c") / percent) - F.col("n")
    least = F.ceil(percent * F.col("n") / 100)
    sized = told.where((F.col("comp") != F.col("hub_comp")) & (most >= least)).select("hub", "rep", "n", "comp", F.explode(F.sequence(least, most)).alias("size"))
    close = sized.alias("x").join(told.select("hub", "rep", F.col("n").alias("size"), "comp", "c").alias("y"), ["hub", "size"]).where(
        (F.col("x.comp") != F.col("y.comp")) & ((100 + percent) * F.col("y.c") >= percent * (F.col("size") + F.col("x.n"))))
    found = [d.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")) for d in (shared, close)]
    return found[0].unionByName(found[1]).unionByName(hub_links).distinct()


def crowd_links(docs: DataFrame, signed: DataFrame, classes: DataFrame, runs: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Links (a, b) that join what `found` leaves apart in the crowded runs; None if nothing is apart."""
    keys = signed.where("n > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("rep"), "n", "minima").mapInArrow(
        place, "key binary, rep bigint, n bigint, b0 bigint, b1 bigint").withColumn("key", F.substring("key", 1, 1 + 4 * least_depth(percent)))
    members = keys.join(lookup_side(runs, 48), "key", "left_semi").join(classes.select("rep"), "rep", "left_semi").select(
        F.xxhash64("key").alias("run"), "rep", "n", "b0", "b1").distinct()
    named = found.select(F.col("node").alias("rep"), F.col("component"))
    crowd = members.join(named, "rep", "left").select("run", "rep", "n", "b0", "b1", F.coalesce("component", "rep").alias("comp"))

    def apart(crowd: DataFrame) -> DataFrame:
        crowd = kept.settle(crowd)
        several = crowd.groupBy("run").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("run")
        left = kept.settle(crowd.join(lookup_side(several, 16), "run", "left_semi"))
        kept.drop(1)
        return left

    def joined(links: DataFrame, pairs: DataFrame) -> DataFrame:
        """(comp, component) of the components that the links join."""
        over = links.join(pairs, ["a", "b"]).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
        return components(settle(over)).withColumnRenamed("node", "comp")

    kept = Rounds(docs.sparkSession)
    crowd, links, sets = apart(crowd), None, None
    for turn in range(HUBS):
        rows = crowd.count()
        if not rows:
            return links
        if sets is None:
            sets = full_sets(docs, classes.join(crowd.select("rep").distinct(), "rep"), width)
        sizes = crowd.groupBy("run", "comp").count().groupBy("run").agg((F.sum("count") * F.sum("count") - F.sum(F.col("count") * F.col("count"))).alias("x"))
        if sizes.agg(F.sum("x")).first()[0] <= 2 * NEAR * rows:
            break
        pairs = settle(_meet(crowd, _hubs(_outside(crowd) if turn else crowd), percent))
        more = settle(confirm(pairs.select("a", "b"), sets, percent))
        if not more.head(1):
            break
        links = more if links is None else links.unionByName(more)
        crowd = apart(crowd.join(lookup_side(joined(more, pairs), 16), "comp", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component"))
    more = settle(confirm(settle(_by_differences(crowd, sets, percent)), sets, percent))
    return more if links is None else links.unionByName(more)


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    signed = settle(signatures(docs, width))
    classes = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    classes = settle(classes)
    own = signed.alias("s").join(classes.alias("c"), (F.col("s.doc_id") == F.col("c.rep")) & (F.col("s.h1") == F.col("c.h1")) & (F.col("s.h2") == F.col("c.h2")))
    placed = own.select("rep", "n", "minima").dropDuplicates(["rep", "minima"]).mapInArrow(place, "key binary, rep bigint, n bigint, b0 bigint, b1 bigint")
    pairs, runs = candidates(placed, percent)
    pairs, runs = settle(pairs), settle(runs)

    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = full_sets(docs, classes.join(ends, "rep"), width)
    either = pairs.select("a", "b", "agree", F.explode(F.array("a", "b")).alias("of"))
    best = either.groupBy("of").agg(F.max(F.struct("agree", F.negative("a").alias("x"), F.negative("b").alias("y"))).alias("m"))
    first = best.select(F.negative("m.x").alias("a"), F.negative("m.y").alias("b")).distinct()
    links = settle(confirm(first, sets, percent))
    found = components(links)
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    rest = pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b").join(first, ["a", "b"], "left_anti")
    # Classes that share an id hold together through it.
    shared = signed.where("n > 0").select("doc_id", "h1", "h2").distinct().join(classes, ["h1", "h2"]).where("doc_id != rep").groupBy("doc_id").agg(
        F.collect_set("rep").alias("reps")).where(F.size("reps") > 1).select(F.explode("reps").alias("a"), F.element_at("reps", 1).alias("b"))
    links = settle(links.unionByName(confirm(rest, sets, percent)).unionByName(shared))
    found = components(links)
    if runs.head(1):
        found = settle(found)
        more = crowd_links(docs, signed, classes, runs, found, width, percent)
        if more is not None:
            found = components(settle(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))

    known = classes.join(found, F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies: that of the smallest id. Rows without id stay."""
    found = near_duplicates(docs, width, percent)
    gone = settle(found.where(~F.col("kept")).select("doc_id").distinct())
    left = docs.join(lookup_side(gone, 16), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
    again = settle(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not again.head(1):
        return left
    again = lookup_side(again, 16)
    once = left.join(again, "doc_id", "left_anti").select(*left.columns)
    return once.unionByName(left.join(again, "doc_id", "left_semi").select(*left.columns).dropDuplicates(["doc_id"]))
