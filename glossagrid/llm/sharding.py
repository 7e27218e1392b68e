"""Sampled splitters: size-weighted key samples, quantile boundaries, subdivided ranges.

Records are put into `n_shards` contiguous key ranges of nearly equal total size.
A bounded, size-weighted sample gives quantile boundaries of many small ranges;
their true sizes are then measured over all records. A range that is overfull by size or by
rows, as one key may hold a third of all rows, is subdivided; the ranges are dealt to the
shards in order by the middle of their cumulative size. Equal keys share a shard
unless their own range had to be subdivided.

The slot is the place within the shard, gapless from 0. Null keys and null sizes
count as 0. Repeated rows get a slot each. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle

RANGES_PER_SHARD = 512
ROWS_PER_RANGE = 100_000
MOST_RANGES = 1 << 16
SAMPLE_PER_RANGE = 32


def locate(key: Column, splitters: list[int]) -> Column:
    """Number of splitters not above the key, by binary search in a literal array."""
    if not splitters:
        return F.lit(0)
    held, n = F.lit(splitters).cast("array<bigint>"), len(splitters)
    steps = F.lit([1 << k for k in reversed(range(n.bit_length()))]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= n) & (F.get(held, at + step - 1) <= key), at + step).otherwise(at))


def splitters_of(rows: DataFrame, key: str, size: str, n: int, total: int) -> list[int]:
    """At most 2n sorted boundaries from a size-weighted sample of about 32n draws."""
    rate = F.col(size) * F.lit(float(SAMPLE_PER_RANGE * n) / max(total, 1))
    draw = (F.xxhash64(F.lit("sample"), *rows.columns) % F.lit(1 << 30) + F.lit(1 << 30)) / F.lit(float(1 << 31))
    drawn = rows.where(draw < rate).select(key, F.explode(F.array_repeat(F.lit(0), F.greatest(F.lit(1), F.round(rate)).cast("int"))))
    at = F.lit([k / n for k in range(1, n)]).cast("array<double>")
    found = drawn.agg(F.percentile_approx(key, at, 20 * n)).first()[0] if n > 1 else None
    once = sorted(set(found or []))
    hot = {x for x, y in zip(found or [], (found or [])[1:]) if x == y and x < (1 << 63) - 1}
    return sorted({*once, *(x + 1 for x in hot)})


def shard_by_size(records: DataFrame, n_shards: int, key: str, size: str) -> DataFrame:
    """The records with `shard` (0 to n_shards - 1) and `slot` (from 0).

    `key` is an integer column; equal keys form a group. Columns named like the
    results are replaced.
    """
    inner = {c: f"c{i}" for i, c in enumerate(c for c in records.columns if c not in ("shard", "slot"))}
    rows = settle(records.select(
        *[F.col(f"`{c}`").alias(a) for c, a in inner.items()],
        F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(0)).alias("key"),
        F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)).alias("size"),
        F.monotonically_increasing_id().alias("at")))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_ranges = max(1, min(max(RANGES_PER_SHARD * n_shards, math.ceil(n / ROWS_PER_RANGE)), MOST_RANGES))
    ranged = rows.withColumn("range", locate(F.col("key"), splitters_of(rows, "key", "size", n_ranges, total)))

    goal = F.lit(max(total / n_ranges, 1.0))
    # One row per range, so at most 2 * MOST_RANGES rows; the broadcasts below are of this table.
    measured = settle(ranged.groupBy("range").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n"), (F.min("key") == F.max("key")).alias("one_key")))
    # A part is sorted in one task, so its rows are bounded as its bytes are.
    wanted = F.greatest(F.when(F.col("bytes") > 2 * goal, F.ceil(F.col("bytes") / goal)),
                        F.when(F.col("n") > 2 * ROWS_PER_RANGE, F.ceil(F.col("n") / ROWS_PER_RANGE)))
    overfull = measured.where(wanted.isNotNull() & (F.col("n") > 1)).select(
        "range", "one_key", F.least(wanted, F.col("n")).cast("int").alias("parts"))
    # A range of one key is cut by row, any other between keys. Repeated rows have numbers of their own.
    by_row = F.xxhash64(F.lit("part"), F.col("at"))
    cut = F.when(F.col("one_key"), by_row).otherwise(F.xxhash64(F.lit("part"), F.col("key")))
    parted = ranged.join(F.broadcast(overfull), "range", "left").withColumn(
        "part", F.coalesce(F.pmod(cut, F.col("parts")).cast("int"), F.lit(0)))

    sizes = parted.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.coalesce(F.sum("bytes").over(before), F.lit(0)) + F.col("bytes") / 2
    dealt = sizes.withColumn("shard", F.least(F.floor(middle * n_shards / max(total, 1)), F.lit(n_shards - 1)).cast("int"))
    within = Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    dealt = settle(dealt.select("range", "part", "shard", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("first")))

    place = Window.partitionBy("range", "part").orderBy("key", *inner.values(), "at")
    numbered = parted.withColumn("nth", F.row_number().over(place) - 1)
    return numbered.join(F.broadcast(dealt), ["range", "part"]).select(
        *[F.col(a).alias(c) for c, a in inner.items()], "shard", (F.col("first") + F.col("nth")).alias("slot"))
