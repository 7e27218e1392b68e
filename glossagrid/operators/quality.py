"""Data-quality operators: problems as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.joins import match_keys
from ..session import lookup_side, settle

KEY = ("method", "seed", "fold", "target_lang")


def duplicate_results(rows: DataFrame, run: str = "run_name") -> DataFrame:
    """Keys reported by several rows: a row per key and run that reports it."""
    keys = [k for k in KEY if k in rows.columns]
    if run not in rows.columns:
        rows = rows.withColumn(run, F.lit("?"))
    per_run = rows.groupBy(*keys, run).agg(F.count(F.lit(1)).alias("n_rows"))
    total = F.sum("n_rows").alias("n_total")
    doubled = per_run.groupBy(*keys).agg(total).where("n_total > 1")
    return match_keys(per_run, doubled, keys)


def incomplete_seeds(table: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Cells with fewer seeds than the fullest cell."""
    table = settle(table)             # read twice
    full = table.agg(F.max("n_seeds")).scalar()
    return table.select(*cell, "n_seeds", full.alias("max_seeds")).where(F.col("n_seeds") < F.col("max_seeds"))


def incomplete_items(long: DataFrame) -> DataFrame:
    """Languages with fewer items than the fullest language (incomplete folds)."""
    per_lang = long.groupBy("target_lang").agg(F.max("n_items").alias("n_items"))
    # A row per language here.
    full = F.max("n_items").over(W.partitionBy())
    return per_lang.withColumn("max_items", full).where(F.col("n_items") != F.col("max_items"))


def baseline_spread(table: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Target groups whose baseline accuracy depends on the source (it must not)."""
    spread = F.max("zero_shot_acc") - F.min("zero_shot_acc")
    return table.groupBy("target_group").agg(
        spread.alias("spread"), F.count(F.lit(1)).alias("n_sources"),
        F.min("n_langs").alias("min_langs"), F.max("n_langs").alias("max_langs"),
    ).where(F.col("spread") > tolerance)


def backbones(rows: DataFrame) -> DataFrame:
    """Distinct backbones and whether there is exactly one, as there must be."""
    found = rows.dropna(subset=["llm"]).groupBy("llm").agg(F.count(F.lit(1)).alias("n_rows"))
    # A row per backbone here.
    return found.withColumn("ok", F.count(F.lit(1)).over(W.partitionBy()) == 1)


def split_sizes(rows: DataFrame, expected: Mapping[str, int], lang: str = "lang", split: str = "split") -> DataFrame:
    """Split sizes per language beside the expected ones."""
    counted = rows.groupBy(lang).agg(
        *[F.count_if(F.col(split) == s).alias(f"n_{s}") for s in expected],
        F.count_if(~F.col(split).isin(list(expected))).alias("n_other"))
    ok = F.col("n_other") == 0
    for s, n in expected.items():
        ok = ok & (F.col(f"n_{s}") == n)
    return counted.withColumn("ok", ok)


def entry_violations(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Run entries that break a rule, one row per (name, rule).

    Columns: name, source_group, fold, dirs, mode, separate_test (bool),
    tune_only (bool), adapter.
    """
    known = groups.select(F.col("group").alias("source_group")).distinct().withColumn("_known", F.lit(True))
    # Many entries may have no group; a broadcast keeps them where they are.
    e = entries.join(lookup_side(known), "source_group", "left")
    tuned = F.coalesce(F.col("separate_test"), F.lit(False)) | F.coalesce(F.col("tune_only"), F.lit(False))
    adapted = F.coalesce(F.col("adapter"), F.lit("")) != ""
    shapes = (
        F.coalesce(F.col("separate_test"), F.lit(False)).cast("int")
        + F.coalesce(F.col("tune_only"), F.lit(False)).cast("int") + adapted.cast("int"))
    mode_ok = F.when(tuned, F.col("mode").isin("finetune", "train")).otherwise(F.col("mode").isin("test", "evaluate"))
    rules = {
        "unknown_source_group": F.col("source_group").isNotNull() & F.col("_known").isNull(),
        "missing_source_group": F.col("source_group").isNull() & (shapes > 0),
        "fold_on_unfolded_path": F.col("fold").isNotNull() & ~F.col("dirs").rlike(r"(^|/)fold\d+(/|$)"),
        "exclusive_shapes": shapes > 1,
        "mode_mismatch": ~mode_ok,
    }
    broken = F.filter(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()]), lambda r: r.isNotNull())
    return e.select("name", F.explode(broken).alias("rule"))
