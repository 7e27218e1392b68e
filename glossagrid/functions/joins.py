"""Joins in which a null key equals a null key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null included; the keys appear once."""
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = left.alias("l").join(right.alias("r"), same, how)
    if how in ("left_semi", "left_anti"):
        return joined
    one = {k: F.coalesce(f"l.{k}", f"r.{k}") if how == "full_outer" else F.col(f"l.{k}") for k in keys}
    return joined.select(
        *[c.alias(k) for k, c in one.items()],
        *[f"l.{c}" for c in left.columns if c not in keys], *[f"r.{c}" for c in right.columns if c not in keys])
