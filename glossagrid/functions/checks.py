"""Row checks that fail inside the running job, and set checks that fail before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


class DataProblem(ValueError):
    """Input that an operator must refuse."""


def sure(value: Column, ok: Column, message: Column, kind: str) -> Column:
    """`value` where `ok` holds; otherwise the job fails with `message`.

    Adds no pass over the data.
    """
    return F.when(ok, value).otherwise(F.raise_error(message).cast(kind))


def refuse(problems: DataFrame, message: str, show: int = 20) -> None:
    """Raise listing up to `show` problem rows, if there are any."""
    found = [tuple(r) for r in problems.limit(show).collect()]
    if found:
        raise DataProblem(f"{message}: {sorted(found, key=str)}")


def need_columns(df: DataFrame, required, what: str = "rows") -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise DataProblem(f"{what}: columns {missing} are absent")


def null_if_nan(column: Column) -> Column:
    return F.when(~F.isnan(column), column)
