"""Ranks, samples and heads that never put one whole group into one task.

Two ways give an exact position without a single-task sort:

* by digest: digest buckets of a group are counted (more of them for more rows), the
  running counts give each bucket its first position, and only rows of one bucket
  are sorted together;
* by order: the rows are range-partitioned on (group, order), written once, and
  numbered from per-partition counts.

The id or order columns must identify a row, so that the result is determined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.draws import ROWS_PER_BUCKET, bucket_digits, bucket_of, digest
from ..functions.joins import match_keys
from ..session import lookup_side, settle

_DIG, _BUC, _CNT, _START, _TOTAL = "_digest", "_bucket", "_count", "_start", "_total"


def _bucket_starts(tagged: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, bucket) with its row count, first position and the group total."""
    counts = tagged.groupBy(*group, _BUC).agg(F.count(F.lit(1)).alias(_CNT))
    span = W.partitionBy(*group) if group else W.partitionBy()
    before = span.orderBy(_BUC).rowsBetween(W.unboundedPreceding, -1)
    return counts.select(
        "*",
        F.coalesce(F.sum(_CNT).over(before), F.lit(0)).alias(_START),
        F.sum(_CNT).over(span).alias(_TOTAL),
    )


def _tagged(df: DataFrame, ids: Sequence[str], seed, digits: int | None) -> DataFrame:
    """The rows with their digest, computed once, and its bucket."""
    rows = settle(df.withColumn(_DIG, digest(seed, *ids)))
    return rows.withColumn(_BUC, bucket_of(F.col(_DIG), digits or bucket_digits(rows.count())))


def digest_rank(
    df: DataFrame,
    ids: Sequence[str],
    *,
    seed,
    group: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in the digest order of its group."""
    tagged = _tagged(df, ids, seed, digits)
    starts = lookup_side(_bucket_starts(tagged, group).drop(_CNT))
    inside = W.partitionBy(*group, _BUC).orderBy(_DIG, *ids)
    ranked = match_keys(tagged, starts, [*group, _BUC]).withColumn(
        rank, F.col(_START) + F.row_number().over(inside) - 1
    )
    if total:
        ranked = ranked.withColumn(total, F.col(_TOTAL))
    return ranked.drop(_DIG, _BUC, _START, _TOTAL)


def keep_drawn(
    df: DataFrame,
    ids: Sequence[str],
    quota: Callable[[Column], Column],
    *,
    seed,
    group: Sequence[str] = (),
    digits: int | None = None,
) -> DataFrame:
    """Keep the first `quota(group size)` rows of each group in digest order.

    Buckets wholly inside the quota pass as they are; only the one bucket that
    holds the cut is sorted.
    """
    tagged = _tagged(df, ids, seed, digits)
    room = _bucket_starts(tagged, group).select(
        *group, _BUC, _CNT, (quota(F.col(_TOTAL)) - F.col(_START)).alias("_room")
    ).where(F.col("_room") > 0)
    room = lookup_side(room)
    open_rows = match_keys(tagged, room, [*group, _BUC])
    whole = open_rows.where(F.col("_room") >= F.col(_CNT))
    edge = (
        open_rows.where(F.col("_room") < F.col(_CNT))
        .withColumn("_pos", F.row_number().over(W.partitionBy(*group, _BUC).orderBy(_DIG, *ids)))
        .where(F.col("_pos") <= F.col("_room"))
    )
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))


def position(
    df: DataFrame,
    order: Sequence[str],
    *,
    group: Sequence[str] = (),
    descending: Sequence[str] = (),
    rank: str = "rank",
    partitions: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row by `order` inside its group.

    Large groups are spread over many range partitions. The rows themselves are laid
    out, so each keeps one position also where keys repeat; which of equal keys
    comes first is then open.
    """
    return _placed(df, order, group, descending, rank, partitions)


def _placed(keys: DataFrame, order, group, descending, rank, partitions) -> DataFrame:
    by = [*group, *[F.desc(o) if o in descending else F.asc(o) for o in order]]
    laid = keys.repartitionByRange(partitions, *by) if partitions else keys.repartitionByRange(*by)
    laid = settle(laid.sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    # One row per partition of the laid-out table.
    counts = laid.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias(_CNT))
    starts = counts.select(
        "_part",
        F.coalesce(
            F.sum(_CNT).over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias(_START),
    )
    placed = laid.withColumn("_part", part).join(F.broadcast(starts), "_part")
    overall = F.col(_START) + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn(rank, overall).drop("_part", _START, "_row")
    if not group:
        return placed
    firsts = lookup_side(placed.groupBy(*group).agg(F.min(rank).alias("_first")))
    return match_keys(placed, firsts, group).select(*keys.columns, (F.col(rank) - F.col("_first")).alias(rank))


def head_of_groups(
    df: DataFrame, order: Sequence[str | Column], size: Column | int, *, group: Sequence[str], salts: int | None = None
) -> DataFrame:
    """The first `size` rows of each group by `order`.

    Ranked first inside salted parts of a group, so a hot group sends at most
    `salts * size` rows to its last task. There is a part for every ROWS_PER_BUCKET
    rows of the largest group, unless a number is given.
    """
    if salts is None:
        largest = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 1
        salts = max(1, -(-largest // ROWS_PER_BUCKET))
    size = F.lit(size) if isinstance(size, int) else size
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in group]), F.lit(salts))
    part = W.partitionBy(*group, "_salt").orderBy(*keys)
    full = W.partitionBy(*group).orderBy(*keys)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_pos", F.row_number().over(part)).where(F.col("_pos") <= size)
        .withColumn("_pos", F.row_number().over(full)).where(F.col("_pos") <= size)
        .drop("_salt", "_pos")
    )
