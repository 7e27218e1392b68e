"""Reproducible pseudo-random draws from md5, the same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Leading hex digits of a digest that name its bucket: 16**3 = 4096 buckets at least,
# and one digit more for each sixteenfold of the rows beyond ROWS_PER_BUCKET in each.
BUCKET_DIGITS = 3
ROWS_PER_BUCKET = 100_000


def digest(seed, *parts) -> Column:
    """md5 of `seed|part|part...` as hex text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p) if isinstance(p, str) else p for p in parts]))


def bucket_digits(rows: int) -> int:
    digits = BUCKET_DIGITS
    while rows > ROWS_PER_BUCKET * 16 ** digits:
        digits += 1
    return digits


def bucket_of(digest_col: Column, digits: int = BUCKET_DIGITS) -> Column:
    return F.substring(digest_col, 1, digits)


def draw_int(seed, *parts) -> Column:
    """Integer in [0, 2**60) read from the first fifteen hex digits of the digest.

    Taken modulo any group size, so large a range leaves no slot out and no bias to speak of.
    """
    return F.conv(F.substring(digest(seed, *parts), 1, 15), 16, 10).cast("bigint")


def draw_unit(seed, *parts) -> Column:
    """Draw in [0, 1)."""
    return draw_int(seed, *parts) / F.lit(float(1 << 60))
