"""Bootstrap of cluster metrics: Poisson weights in place of drawn rows, intervals and tests.

In a resample of n out of n rows each row occurs about Poisson(1) times. Every row gets
its count for each replicate from a digest of (group, replicate, id), so no
draw is ever a row of its own, nothing is ranked, and a replicate is the same
wherever it is computed. Rows are sharded inside their cluster, and only sums per
(replicate, cluster) move.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import draw_unit
from ..session import keyed, lookup_side, settle
from .vectors import _as_vectors, _between, _dispersion_ratio, davies_bouldin_of, ddl

# Rows of one cluster handled together in a task, and in one step of it.
ROWS_PER_SHARD = 32768
ROWS_PER_STEP = 2048
# P(count <= k) of a Poisson(1) count; larger counts have less than 1e-9.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


def replicate_weights(rows: DataFrame, replicates: int, *, by: Sequence[str], id: str, seed=42) -> DataFrame:
    """The rows with `w`: how often each replicate holds the row."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda rep: draw_unit(seed, *by, rep, id))
    counts = F.transform(draws, lambda u: sum((F.when(u >= t, 1).otherwise(0) for t in POISSON), F.lit(0)).cast("tinyint"))
    return rows.withColumn("w", counts)


def _steps(pdf: pd.DataFrame):
    """Vectors and weights (rows by replicates) of a shard, a bounded number of rows at a time."""
    for at in range(0, len(pdf), ROWS_PER_STEP):
        part = pdf.iloc[at:at + ROWS_PER_STEP]
        yield np.stack(part["x"].to_numpy()), np.stack(part["w"].to_numpy()).astype(float)


def replicate_metrics(rows: DataFrame, replicates: int, *, by: Sequence[str], cluster: str, id: str,
                      vector: str = "embedding", seed=42, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """(by, rep): Davies-Bouldin and Calinski-Harabasz of every replicate."""
    by = list(by)
    keys = [*by, cluster]
    sizes = lookup_side(rows.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(rows_per_shard)).cast("int").alias("shards")))
    weighted = replicate_weights(rows.select(*keys, id, vector), replicates, by=by, id=id, seed=seed)
    sharded = settle(weighted.join(sizes, keys).select(
        *keys, F.pmod(F.xxhash64(id), "shards").cast("int").alias("shard"), F.col(vector).alias("x"), "w"))
    cell = [*keys, "shard"]

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        n, total = np.zeros(replicates), 0.0
        for x, w in _steps(pdf):
            n += w.sum(axis=0)
            total = total + w.T @ x
        used = np.flatnonzero(n)
        out = pd.DataFrame({"rep": used, "n": n[used].astype(int), "packed": list(total[used])})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out

    partial = keyed(sharded, cell).applyInPandas(sums, f"rep int, n bigint, packed array<double>, {ddl(sharded, keys)}")
    tall = partial.select(*keys, "rep", "n", F.posexplode("packed").alias("dim", "s")).groupBy(*keys, "rep", "dim").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"))
    means = settle(_as_vectors(tall.withColumn("m", F.col("s") / F.col("n")), [*keys, "rep"], "m", "centroid"))
    # A shard holds far more rows than replicates, so the centroids sent to it are the smaller part.
    everywhere = means.join(sizes, keys).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))

    def spreads(pdf: pd.DataFrame, centers: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or centers.empty:
            return pd.DataFrame({"rep": [], "total": [], "squares": [], **{k: [] for k in keys}})
        reps = centers["rep"].to_numpy()
        total, squares = np.zeros(len(reps)), np.zeros(len(reps))
        for x, w in _steps(pdf):
            for i, (rep, center) in enumerate(zip(reps, centers["centroid"])):
                held = np.flatnonzero(w[:, rep])
                away = ((x[held] - np.asarray(center)) ** 2).sum(axis=1)
                squares[i] += w[held, rep] @ away
                total[i] += w[held, rep] @ np.sqrt(away)
        out = pd.DataFrame({"rep": reps, "total": total, "squares": squares})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out

    spread = settle(keyed(sharded, cell).cogroup(keyed(everywhere, cell)).applyInPandas(
        spreads, f"rep int, total double, squares double, {ddl(sharded, keys)}").groupBy(*keys, "rep").agg(
        F.sum("total").alias("total"), F.sum("squares").alias("squares")))
    within = spread.groupBy(*by, "rep").agg(F.sum("squares").alias("within"))
    counts = means.groupBy(*by, "rep").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    ch = within.join(_between(means, [*by, "rep"]), [*by, "rep"]).join(counts, [*by, "rep"]).select(*by, "rep", _dispersion_ratio(
        F.col("b"), F.col("within"), F.col("n"), F.col("k")).alias("calinski_harabasz"))
    table = means.join(spread, [*keys, "rep"]).select(
        *keys, "rep", (F.col("total") / F.col("n")).alias("spread"), "centroid")
    return davies_bouldin_of(table, [*by, "rep"]).join(ch, [*by, "rep"])


def mean_interval(rows: DataFrame, value: str, replicates: int, *, by: Sequence[str], id: str, seed=42) -> DataFrame:
    """95 % interval and standard error of a mean; of an accuracy where `value` is 0 or 1."""
    known = rows.where(F.col(value).isNotNull()).select(*by, id, F.col(value).cast("double").alias("v"))
    each = replicate_weights(known, replicates, by=by, id=id, seed=seed).select(*by, "v", F.posexplode("w").alias("rep", "w")).where("w > 0")
    means = each.groupBy(*by, "rep").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("value"))
    return means.groupBy(*by).agg(*_interval("value"))


def _tall(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in
                      (("db", "davies_bouldin"), ("ch", "calinski_harabasz"))])
    return table.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.*")


def _interval(value: str) -> list[Column]:
    # As many values as replicates.
    ends = F.percentile(value, [0.025, 0.975])
    return [ends[0].alias("ci_l"), ends[1].alias("ci_u"), F.stddev_samp(value).alias("se")]


def bootstrap_ci(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """95 % percentile interval and standard error per group and metric."""
    return _tall(metrics, [*by, "rep"]).groupBy(*by, "metric").agg(*_interval("value"))


def bootstrap_diff_test(metrics: DataFrame, observed: DataFrame, *, by: Sequence[str],
                        methods: Sequence[str] = ("xpe", "spt")) -> DataFrame:
    """Interval, standard error and one-sided p of first minus second method.

    Both methods are resampled independently. `observed` holds the metrics of the
    full samples; its sign picks the side, and zero counts as the wrong side.
    """
    first, second = methods

    def gap(table: DataFrame, keys: list[str], name: str) -> DataFrame:
        of = {m: F.max(F.when(F.col("method") == m, F.col("value"))) for m in methods}
        return _tall(table, [*keys, "method"]).groupBy(*keys, "metric").agg((of[first] - of[second]).alias(name))

    by = list(by)
    diffs = gap(metrics, [*by, "rep"], "diff").join(gap(observed, by, "observed"), [*by, "metric"])
    wrong = F.when(F.col("observed") > 0, F.col("diff") <= 0).otherwise(F.col("diff") >= 0)
    return diffs.groupBy(*by, "metric").agg(
        F.max("observed").alias("diff"), *_interval("diff"),
        ((F.count_if(wrong) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
