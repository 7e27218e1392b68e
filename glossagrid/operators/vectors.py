"""Embedding rows: masks, previews, cluster quality, medians and projection.

Rows carry group columns `by` (for example layer and method), a cluster label, an
id unique inside the group, and a vector as array<double>.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.checks import DataProblem
from ..functions.draws import digest, draw_int
from ..session import keyed, lookup_side, settle
from .ranking import digest_rank, head_of_groups, keep_drawn, position


def ddl(df: DataFrame, columns: Sequence[str]) -> str:
    """Schema text of some columns, for the output of grouped pandas functions."""
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


# ---- selection

def mask_filter(rows: DataFrame, *, states: str = "states", mask: str = "mask", prompt_size: int = 0,
                keep: Sequence[str] = ()) -> DataFrame:
    """One row per kept position: prompt positions count as masked, then mask = 1 stays."""
    padded = F.concat(F.array_repeat(F.lit(0), prompt_size), F.col(mask))
    zipped = F.arrays_zip(F.col(states).alias("state"), padded.alias("m"))
    return rows.select(*keep, F.posexplode(zipped).alias("pos", "z")).where("z.m = 1").select(
        *keep, "pos", F.col("z.state").alias("state"))


def sample_per_group(rows: DataFrame, share: float, *, group: Sequence[str], ids: Sequence[str], seed) -> DataFrame:
    """floor(rows of the group * share) rows per group, without replacement."""
    return keep_drawn(rows, ids, lambda n: F.floor(n * F.lit(share)), seed=seed, group=group)


SMALL_SAMPLE = 10_000


def sample_k(rows: DataFrame, k: int, *, ids: Sequence[str], seed) -> DataFrame:
    """k rows without replacement; all of them if there are no more than k.

    A small k is a top-k of the digests, which each task cuts for itself.
    """
    if k <= SMALL_SAMPLE:
        return rows.orderBy(digest(seed, *ids), *ids).limit(k)
    return keep_drawn(rows, ids, lambda n: F.least(n, F.lit(k)), seed=seed)


def preview(rows: DataFrame, total: int, *, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first max(1, total // groups) rows of each group."""
    groups = max(1, rows.select(*group).distinct().count())
    return head_of_groups(rows, order, max(1, total // groups), group=group)


# ---- sums per cluster and dimension

def _sums(rows: DataFrame, by: Sequence[str], cluster: str, vector: str) -> DataFrame:
    """(by, cluster, dim): n and sum; combined on the map side."""
    return rows.select(*by, cluster, F.posexplode(vector).alias("dim", "x")).groupBy(*by, cluster, "dim").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))


def _dispersion_ratio(between: Column, within: Column, n: Column, k: Column) -> Column:
    return F.when(within == 0, 1.0).otherwise(F.try_divide(F.try_divide(between, k - 1), F.try_divide(within, n - k)))


def _between(means: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of n * |cluster mean - mean|^2 per group, from (by, n, centroid) rows."""
    tall = means.select(*by, "n", F.posexplode("centroid").alias("_dim", "_m"))
    middle = tall.groupBy(*by, "_dim").agg((F.sum(F.col("n") * F.col("_m")) / F.sum("n")).alias("_g"))
    gap = F.col("_m") - F.col("_g")
    return tall.join(middle, [*by, "_dim"]).groupBy(*by).agg(F.sum(F.col("n") * gap * gap).alias("b"))


def calinski_harabasz(rows: DataFrame, *, by: Sequence[str], cluster: str, vector: str = "embedding") -> DataFrame:
    """Between over within dispersion, each per degree of freedom; 1 if within is 0.

    Both are sums of squared distances to means, so large coordinates do no harm.
    """
    by = list(by)
    means = lookup_side(centroids(rows, by=by, cluster=cluster, vector=vector))
    gap = distance(F.col(vector), F.col("centroid"))
    within = rows.join(means, [*by, cluster]).select(*by, (gap * gap).alias("w")).groupBy(*by).agg(F.sum("w").alias("w"))
    sizes = means.groupBy(*by).agg(F.sum("n").alias("n_samples"), F.count(F.lit(1)).alias("n_clusters"))
    totals = within.join(_between(means, by), by).join(sizes, by)
    value = _dispersion_ratio(F.col("b"), F.col("w"), F.col("n_samples"), F.col("n_clusters"))
    return totals.select(*by, value.alias("calinski_harabasz"), "n_samples", "n_clusters")


def centroids(rows: DataFrame, *, by: Sequence[str], cluster: str, vector: str = "embedding") -> DataFrame:
    """(by, cluster): n and the mean vector."""
    sums = _sums(rows, by, cluster, vector)
    return _as_vectors(sums.withColumn("m", F.col("s") / F.col("n")), [*by, cluster], "m", "centroid")


def _as_vectors(tall: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    # One element per dimension of a vector.
    ordered = F.array_sort(F.collect_list(F.struct("dim", F.col(value).alias("v"))))
    return tall.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(ordered, lambda e: e["v"]).alias(name))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda t, x: t + x))


def worst_ratio_mean(spread: np.ndarray, centers: np.ndarray) -> float:
    """Mean over clusters of the worst (spread + spread) / centroid distance."""
    k = len(spread)
    if k < 2:
        return float("nan")
    worst, apart = np.zeros(k), False
    for i in range(k):
        gaps = np.sqrt(((centers - centers[i]) ** 2).sum(axis=1))
        apart = apart or not np.allclose(gaps, 0)
        gaps[gaps == 0] = np.inf
        gaps[i] = np.inf
        worst[i] = ((spread + spread[i]) / gaps).max()
    return 0.0 if np.allclose(spread, 0) or not apart else float(worst.mean())


def davies_bouldin_of(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """From (by, cluster, spread, centroid) rows; a group holds one row per cluster."""
    by = list(by)

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        value = worst_ratio_mean(pdf["spread"].to_numpy(), np.stack(pdf["centroid"].to_numpy()))
        out = pdf[by].iloc[:1].copy()
        out["davies_bouldin"] = value
        return out

    return keyed(table, by).applyInPandas(measure, f"{ddl(table, by)}, davies_bouldin double")


def davies_bouldin(rows: DataFrame, *, by: Sequence[str], cluster: str, vector: str = "embedding") -> DataFrame:
    """Davies-Bouldin index per group: centroids first, then spreads around them."""
    keys = [*by, cluster]
    means = lookup_side(centroids(rows, by=by, cluster=cluster, vector=vector))
    away = rows.join(means, keys).select(*keys, distance(F.col(vector), F.col("centroid")).alias("away"))
    spreads = away.groupBy(*keys).agg(F.avg("away").alias("spread"))
    return davies_bouldin_of(spreads.join(means.select(*keys, "centroid"), keys), by)


# ---- silhouette, Manhattan

# Gaps (rows times clusters) computed together: 4 million doubles.
PART_CELLS = 4_000_000
# Rows of a group times clusters that a task may sum up, dimensions it takes at most, rows it looks at together.
BLOCK_CELLS = 8_000_000
BLOCK_DIMS = 32
CHUNK_ROWS = 4096


def resample(rows: DataFrame, size: int, *, by: Sequence[str], ids: Sequence[str], seed) -> DataFrame:
    """`size` rows per group drawn with replacement; `draw` numbers them."""
    ranked = digest_rank(rows, ids, seed=seed, group=by, rank="_slot", total="_n")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    # Numbers in two steps, so that no row holds an array of the whole sample.
    step = 10_000
    blocks = sizes.select(*by, "_n", F.explode(F.sequence(F.lit(0), F.lit(size - 1), F.lit(step))).alias("_at"))
    draws = blocks.select(*by, "_n", F.explode(F.sequence("_at", F.least(F.col("_at") + step, F.lit(size)) - 1)).alias("draw"))
    draws = draws.withColumn("_slot", draw_int(seed, *by, "draw") % F.col("_n")).drop("_n")
    return draws.join(ranked.drop("_n"), [*by, "_slot"]).drop("_slot")


def _offsets(parts: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Counts and sums per cluster before each part, and over all parts, of one dimension."""
    k = int(parts["k"].iloc[0])
    order = np.sort(parts["part"].unique())
    at = np.searchsorted(order, parts["part"].to_numpy())
    counts, sums = np.zeros((len(order), k)), np.zeros((len(order), k))
    np.add.at(counts, (at, parts["c"].to_numpy()), parts["cnt"].to_numpy())
    np.add.at(sums, (at, parts["c"].to_numpy()), parts["total"].to_numpy())
    before_n, before_s = counts.cumsum(axis=0) - counts, sums.cumsum(axis=0) - sums
    out = pd.DataFrame({"part": order, "before_n": list(before_n), "before_s": list(before_s),
                        "all_n": [counts.sum(axis=0)] * len(order), "all_s": [sums.sum(axis=0)] * len(order)})
    for key in keys:
        out[key] = parts[key].iloc[0]
    return out


def _gaps_to_clusters(rows: pd.DataFrame, offset: pd.DataFrame, block: int = 4096) -> list[np.ndarray]:
    """Sum of |x - y| to every cluster in one dimension, for rows sorted by value."""
    below_n, below_s = np.array(offset["before_n"].iloc[0]), np.array(offset["before_s"].iloc[0])
    all_n, all_s = np.array(offset["all_n"].iloc[0]), np.array(offset["all_s"].iloc[0])
    x, c = rows["x"].to_numpy(), rows["c"].to_numpy()
    out: list[np.ndarray] = []
    for lo in range(0, len(x), block):
        xs, cs = x[lo:lo + block, None], c[lo:lo + block]
        hot = np.zeros((len(cs), len(all_n)))
        hot[np.arange(len(cs)), cs] = 1.0
        n, s = hot.cumsum(axis=0), (hot * xs).cumsum(axis=0)
        bn, bs = below_n + n - hot, below_s + s - hot * xs
        out.extend(xs * bn - bs + (all_s - bs) - xs * (all_n - bn))
        below_n, below_s = below_n + n[-1], below_s + s[-1]
    return out


def _blocked_gaps(placed: DataFrame, by: list[str], most_rows: int | None) -> DataFrame:
    """by, id, c and the sums of gaps to each cluster over a block of dimensions."""
    wide = max(1, min(BLOCK_DIMS, BLOCK_CELLS // max(1, most_rows or 1)))
    at = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("v") / wide).cast("int") - 1, F.lit(0)))
    blocks = placed.select(*by, "id", "c", "k", F.posexplode(F.transform(at, lambda b: F.slice("v", b * wide + 1, F.lit(wide)))).alias("block", "xs"))

    def gaps(pdf: pd.DataFrame) -> pd.DataFrame:
        cs, k = pdf["c"].to_numpy(), int(pdf["k"].iloc[0])
        values = np.stack(pdf["xs"].to_numpy())
        out = np.zeros((len(cs), k))
        all_n = np.bincount(cs, minlength=k).astype(float)
        for column in values.T:
            order = np.argsort(column, kind="stable")
            all_s = np.bincount(cs, weights=column, minlength=k)
            below_n, below_s = np.zeros(k), np.zeros(k)
            for start in range(0, len(order), CHUNK_ROWS):
                rows = order[start:start + CHUNK_ROWS]
                xs = column[rows, None]
                hot = np.zeros((len(rows), k))
                hot[np.arange(len(rows)), cs[rows]] = 1.0
                n, s = below_n + hot.cumsum(axis=0), below_s + (hot * xs).cumsum(axis=0)
                out[rows] += xs * (2 * n - all_n) - 2 * s + all_s
                below_n, below_s = n[-1], s[-1]
        found = pdf[[*by, "id", "c"]].copy()
        found["gaps"] = list(out)
        return found

    return keyed(blocks, [*by, "block"]).applyInPandas(gaps, f"{ddl(blocks, [*by, 'id', 'c'])}, gaps array<double>")


def _ranged_gaps(placed: DataFrame, by: list[str], widest: int, partitions: int | None) -> DataFrame:
    """by, id, c and the gaps to each cluster in one dimension, of groups too large for one task."""
    tall = placed.select(*by, "id", "c", "k", F.posexplode("v").alias("dim", "x"))
    order = [*by, "dim", "x", "id"]
    laid = tall.repartitionByRange(partitions, *order) if partitions else tall.repartitionByRange(*order)
    # Parts follow the order and are small enough that one gap per cluster and row fits.
    part_rows = max(1000, PART_CELLS // widest)
    laid = settle(laid.sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()).withColumn(
        "part", F.shiftleft(F.shiftright("_row", 33), 33) + F.floor(
            F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) / part_rows)).drop("_row"))
    keys = [*by, "dim"]
    per_part = laid.groupBy(*keys, "part", "c", "k").agg(F.count(F.lit(1)).alias("cnt"), F.sum("x").alias("total"))
    offset_schema = (f"part bigint, before_n array<double>, before_s array<double>, all_n array<double>, "
                     f"all_s array<double>, {ddl(laid, keys)}")
    offsets = keyed(per_part, keys).applyInPandas(lambda pdf: _offsets(pdf, keys), offset_schema)

    def gaps(rows_pdf: pd.DataFrame, offset_pdf: pd.DataFrame) -> pd.DataFrame:
        rows_pdf = rows_pdf.sort_values(["x", "id"])
        out = rows_pdf[[*by, "id", "c"]].copy()
        out["gaps"] = _gaps_to_clusters(rows_pdf, offset_pdf)
        return out

    cell = [*keys, "part"]
    return keyed(laid, cell).cogroup(keyed(offsets, cell)).applyInPandas(
        gaps, f"{ddl(laid, [*by, 'id', 'c'])}, gaps array<double>")


def silhouette_manhattan(rows: DataFrame, *, by: Sequence[str], cluster: str, id: str, vector: str = "embedding",
                         sample: int | None = None, seed=42, partitions: int | None = None) -> DataFrame:
    """Mean silhouette under the Manhattan metric, without comparing pairs of rows.

    The metric is a sum over dimensions, and in one dimension the sum of gaps to a
    cluster follows from how many of its values lie below and what they add up to.
    Up to `BLOCK_CELLS` (rows of the largest group times its clusters) a task takes a block of
    dimensions of a group, goes along each of them in sorted order and adds the gaps up, so that one
    number per row, cluster and block moves. Beyond that (or with `partitions`), rows are
    range-partitioned on (group, dimension, value, id) and each partition starts from the
    counts and sums of those before it. `sample`: None takes all rows, 0 skips (0.0), a number
    draws that many with replacement.
    """
    by = list(by)
    if sample == 0:
        return rows.select(*by).distinct().withColumn("silhouette", F.lit(0.0))
    if sample:
        rows = resample(rows, sample, by=by, ids=[id], seed=seed).drop(id).withColumnRenamed("draw", id)
    # One row per cluster: its index and size.
    sizes = rows.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("size"))
    in_group = W.partitionBy(*by)
    sizes = lookup_side(sizes.select(
        *by, cluster, "size", (F.row_number().over(in_group.orderBy(cluster)) - 1).alias("c"),
        F.count(F.lit(1)).over(in_group).cast("int").alias("k")))
    placed = rows.join(sizes, [*by, cluster]).select(*by, F.col(id).alias("id"), "c", "k", F.col(vector).alias("v"))
    most = sizes.groupBy(*by).agg(F.sum("size").alias("n"), F.max("k").alias("k")).agg(F.max("n"), F.max("k"), F.max(F.col("n") * F.col("k"))).first()
    per_dim = _blocked_gaps(placed, by, most[0]) if not partitions and (most[2] or 0) <= BLOCK_CELLS else _ranged_gaps(placed, by, most[1] or 1, partitions)
    # One array per block, or per dimension, of a vector.
    total = F.reduce(
        F.collect_list("gaps"), F.array().cast("array<double>"),
        lambda acc, g: F.when(F.size(acc) == 0, g).otherwise(F.zip_with(acc, g, lambda a, b: a + b)))
    sums = per_dim.groupBy(*by, "id", "c").agg(total.alias("sums"))
    by_index = sizes.groupBy(*by).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("c", "size"))), lambda e: e["size"]).alias("sizes"))
    own_n = F.element_at("sizes", F.col("c") + 1)
    means = F.transform("sums", lambda v, i: F.when(i == F.col("c"), None).otherwise(v / F.element_at("sizes", i + 1)))
    scored = sums.join(lookup_side(by_index), by).select(
        *by, own_n.alias("own"),
        F.when(own_n > 1, F.element_at("sums", F.col("c") + 1) / (own_n - 1)).alias("a"), F.array_min(means).alias("b"))
    top = F.greatest("a", "b")
    value = F.when((F.col("own") > 1) & (top > 0), (F.col("b") - F.col("a")) / top).otherwise(0.0)
    return scored.groupBy(*by).agg(F.avg(value).alias("silhouette"))


# ---- metrics side by side

METRICS = ("silhouette", "davies_bouldin", "calinski_harabasz")
COUNTS = ("n_samples", "n_clusters")


def cluster_quality(rows: DataFrame, *, by: Sequence[str], cluster: str, id: str, vector: str = "embedding",
                    sample: int | None = None) -> DataFrame:
    """All cluster metrics and counts per group."""
    by = list(by)
    ch = calinski_harabasz(rows, by=by, cluster=cluster, vector=vector)
    db = davies_bouldin(rows, by=by, cluster=cluster, vector=vector)
    sil = silhouette_manhattan(rows, by=by, cluster=cluster, id=id, vector=vector, sample=sample)
    return sil.join(db, by).join(ch, by)


def method_diff(quality: DataFrame, *, by: Sequence[str], methods: Sequence[str] = ("xpe", "spt")) -> DataFrame:
    """One row per layer: metrics by method, then first method minus second."""
    def of(method: str, field: str) -> Column:
        return F.max(F.when(F.col("method") == method, F.col(field)))

    wide = quality.groupBy(*by).agg(*[
        of(m, f).alias(f"{m}_{f}") for f in (*METRICS, *COUNTS) for m in methods])
    first, second = methods
    return wide.select("*", *[(F.col(f"{first}_{f}") - F.col(f"{second}_{f}")).alias(f"diff_{f}") for f in METRICS])


# ---- anchors and projection

def group_medians(points: DataFrame, *, label: str, axes: Sequence[str], id: str, skip: Sequence[str] = ("Mixed",)) -> DataFrame:
    """Exact median per label and axis over its known values; labels of any size are ranked in range partitions."""
    kept = points.where(~F.col(label).isin(list(skip)))
    axis = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("x")) for a in axes]))
    tall = kept.select(label, id, axis.alias("p")).select(label, id, "p.axis", "p.x").where("x IS NOT NULL AND NOT isnan(x)")
    placed = position(tall, ["x", id], group=[label, "axis"], rank="r")
    sizes = lookup_side(tall.groupBy(label, "axis").agg(F.count(F.lit(1)).alias("n")))
    middle = placed.join(sizes, [label, "axis"]).where(
        (F.col("r") == F.floor((F.col("n") - 1) / 2)) | (F.col("r") == F.floor(F.col("n") / 2)))
    return middle.groupBy(label).agg(*[F.avg(F.when(F.col("axis") == a, F.col("x"))).alias(f"median_{a}") for a in axes])


def pca_projection(rows: DataFrame, k: int = 2, *, vector: str = "embedding") -> DataFrame:
    """Centred vectors on their first k principal components, as pc1..pck.

    A component's sign is open; it is chosen so that its largest loading is positive.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    base = rows.withColumn("_v", array_to_vector(F.col(vector)))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(base).transform(base)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    parts = vector_to_array("_p")
    return model.transform(centred).withColumns(
        {f"pc{i + 1}": parts[i] * F.lit(float(signs[i] or 1.0)) for i in range(k)}).drop("_v", "_c", "_p")


def stack_sources(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two sets of vectors as one, with the side each row came from."""
    if not first.columns or not second.columns:
        raise DataProblem("no embeddings to stack")
    return first.withColumn("side", F.lit("vocabulary")).unionByName(second.withColumn("side", F.lit("prompt")))
