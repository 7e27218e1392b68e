"""Item-disjoint folds over parallel items, and per-language task ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import FOLD_SEED, FOLD_SPLITS, SPLIT_NAMES
from ..functions.checks import DataProblem, refuse, sure
from .ranking import digest_rank

ITEM = ("link", "question_number")


def parallel_report(items: DataFrame, reference: str | None = None, *, key: Sequence[str] = ITEM, lang: str = "lang") -> DataFrame:
    """Per language: keys it lacks and keys it has beyond the reference language.

    The reference is the first language by name unless given.
    """
    if reference is None:
        reference = items.agg(F.min(lang)).first()[0]
    # One shuffle by item; the languages that have an item are a short set.
    marks = items.groupBy(*key).agg(F.collect_set(lang).alias("langs"))
    per_lang = marks.select(
        F.array_contains("langs", reference).alias("in_base"), F.explode("langs").alias(lang)).groupBy(lang).agg(
        F.count_if("in_base").alias("shared"), F.count_if(~F.col("in_base")).alias("n_extra"))
    # The reference shares all its items with itself, which is its size (a row per language here).
    size = F.max(F.when(F.col(lang) == reference, F.col("shared"))).over(W.partitionBy())
    missing = F.coalesce(size, F.lit(0)) - F.col("shared")
    return per_lang.select(
        lang, missing.alias("n_missing"), "n_extra", ((missing == 0) & (F.col("n_extra") == 0)).alias("ok"))


def drop_unparallel(items: DataFrame, report: DataFrame, lang: str = "lang") -> DataFrame:
    """Without the languages whose key set deviates; they are left out whole."""
    return items.join(report.where(~F.col("ok")).select(lang), lang, "left_anti")


def _split_of(r: Column, f: Column, train: Column, val: Column, test: Column) -> Column:
    rest = r - F.when(r >= (f + 1) * test, test).otherwise(F.lit(0))
    return (
        F.when((r >= f * test) & (r < (f + 1) * test), "test").when(rest < val, "val").when(rest < val + train, "train"))


def fold_plan(
    keys: DataFrame, key: Sequence[str] = ITEM, *, n_splits: int = FOLD_SPLITS["n_splits"],
    train: int | None = None, val: int | None = None, test: int | None = None,
    val_share: int | None = None, seed=FOLD_SEED,
) -> DataFrame:
    """(key, places): the (fold, split) pairs of each item; test blocks are disjoint.

    Items are ranked by digest of (seed, key), so the result depends neither on
    input order nor on language. Give the three sizes, whose test blocks must tile the
    item set, or `val_share`: a test block is 1/n_splits of all items and validation
    1/val_share, both rounded down, and train the rest. Fewer than n_splits items
    are then left over; they are in no test block.
    """
    distinct = keys.select(*key).distinct()
    ranked = digest_rank(distinct, key, seed=seed, rank="_r", total="_n")
    n = F.col("_n")
    if test is None and val_share is None:
        train, val, test = FOLD_SPLITS["train"], FOLD_SPLITS["val"], FOLD_SPLITS["test"]
    if val_share is None:
        tr, va, te = F.lit(train), F.lit(val), F.lit(test)
    else:
        te, va = F.floor(n / n_splits), F.floor(n / val_share)
        tr = n - te - va
    fits = (te * n_splits == n) & (tr + va + te == n) if val_share is None else tr >= 0
    message = F.concat_ws(" ", F.lit("fold sizes do not fit the number of items:"), n, F.lit("items, test"), te,
                          F.lit("train"), tr, F.lit("val"), va)
    ranked = ranked.withColumn("_r", sure(F.col("_r"), fits, message, "bigint"))
    names = F.create_map(*[F.lit(x) for pair in SPLIT_NAMES.items() for x in pair])
    places = F.array(*[F.struct(
        F.lit(f).alias("fold"),
        F.try_element_at(names, _split_of(F.col("_r"), F.lit(f), tr, va, te)).alias("split")) for f in range(n_splits)])
    return ranked.select(*key, places.alias("places"))


def assign_fold_splits(keys: DataFrame, key: Sequence[str] = ITEM, **geometry) -> DataFrame:
    """(key, fold, split) for every fold; see `fold_plan`."""
    return fold_plan(keys, key, **geometry).select(*key, F.inline("places"))


def fold_rows(records: DataFrame, plan: DataFrame, key: Sequence[str] = ITEM) -> DataFrame:
    """Each record once per fold with its split, the same in every language.

    Joined before the folds are opened, so an item moves once.
    """
    return records.join(plan, list(key)).select(*records.columns, F.inline("places"))


def task_ids(rows: DataFrame, langs: Sequence[str] | None = None, lang: str = "lang", strict: bool = True) -> DataFrame:
    """Rows of the languages tagged with the language's index in sorted order.

    A language without rows is an error, since it would leave a task without data.
    """
    if langs is not None:
        order = sorted(set(langs))
        if strict:
            held = {r[0] for r in rows.where(F.col(lang).isin(order)).select(lang).distinct().collect()}
            if missing := [x for x in order if x not in held]:
                raise DataProblem(f"no rows of {missing}")
        place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(lang)) - 1
        return rows.where(F.col(lang).isin(order)).withColumn("task_ids", place.cast("int"))
    # One row: the sorted set of languages.
    names = rows.agg(F.array_sort(F.collect_set(lang))).scalar()
    return rows.withColumn("task_ids", (F.array_position(names, F.col(lang)) - 1).cast("int"))


def select_partition(rows: DataFrame, *, lang: str | None = None, fold: int | None = None,
                     folded: bool = True) -> DataFrame:
    """Rows of one language and one fold, by partition pruning.

    `folded` says whether the dataset has folds; asking a fold of an unfolded
    dataset is an error, asking none leaves the rows without a fold.
    """
    if fold is not None and not (folded and "fold" in rows.columns):
        raise DataProblem(f"fold={fold} asked of a dataset without folds")
    if lang is not None:
        rows = rows.where(F.col("lang") == lang)
    if "fold" in rows.columns:
        rows = rows.where(F.col("fold").isNull() if fold is None else F.col("fold") == fold)
    return rows


def check_parallel(report: DataFrame) -> None:
    refuse(report.where(~F.col("ok")), "languages with a deviating key set")
