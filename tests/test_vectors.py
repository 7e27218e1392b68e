import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glossagrid.functions import draws
from glossagrid.operators import bootstrap as S, ranking as K, vectors as V


def data(n=90, d=5, k=4, seed=0, hot=False):
    rng = np.random.default_rng(seed)
    c = rng.integers(0, k, n)
    if hot:
        c[: n // 3] = 0
    x = rng.normal(size=(n, d)) + c[:, None] * 0.7
    if hot:
        x[: n // 3] = 1.0         # copies of one vector hold a third of all rows
    x[:, 0] = np.round(x[:, 0])   # equal values in one dimension
    return x, c


def frame(spark, x, c, g=None):
    rows = [(int(i), f"c{int(ci)}", [float(v) for v in xi], "a" if g is None else g[i]) for i, (xi, ci) in enumerate(zip(x, c))]
    return spark.createDataFrame(rows, "id bigint, lang string, embedding array<double>, g string")


def db(x, c):
    ks = np.unique(c)
    mu = np.array([x[c == k].mean(0) for k in ks])
    s = np.array([np.linalg.norm(x[c == k] - m, axis=1).mean() for k, m in zip(ks, mu)])
    return np.mean([max((s[i] + s[j]) / np.linalg.norm(mu[i] - mu[j]) for j in range(len(ks)) if j != i) for i in range(len(ks))])


def ch(x, c):
    ks, n = np.unique(c), len(x)
    b = sum((c == k).sum() * ((x[c == k].mean(0) - x.mean(0)) ** 2).sum() for k in ks)
    w = sum(((x[c == k] - x[c == k].mean(0)) ** 2).sum() for k in ks)
    return (b / (len(ks) - 1)) / (w / (n - len(ks)))


def sil(x, c):
    dist = np.abs(x[:, None] - x[None]).sum(-1)
    out = []
    for i in range(len(x)):
        own = c == c[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = dist[i][own].sum() / (own.sum() - 1)
        b = min(dist[i][c == k].mean() for k in np.unique(c) if k != c[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.mean(out)


@pytest.mark.parametrize("hot", [False, True])
def test_metrics_equal_brute_force(spark, hot):
    x, c = data(hot=hot)
    c[-1] = 9                     # a cluster of one row
    rows = frame(spark, x, c)
    got = V.cluster_quality(rows, by=["g"], cluster="lang", id="id").first()
    assert got["davies_bouldin"] == pytest.approx(db(x, c))
    assert got["calinski_harabasz"] == pytest.approx(ch(x, c))
    assert got["silhouette"] == pytest.approx(sil(x, c))
    assert (got["n_samples"], got["n_clusters"]) == (len(x), len(np.unique(c)))


def test_silhouette_over_many_parts_and_groups(spark, monkeypatch):
    monkeypatch.setattr(V, "PART_CELLS", 0)       # smallest parts
    x, c = data(1500, 2)
    g = ["a" if i % 3 else "b" for i in range(1500)]
    mask = np.array([v == "a" for v in g])
    got = {r["g"]: r["silhouette"] for r in V.silhouette_manhattan(
        frame(spark, x, c, g), by=["g"], cluster="lang", id="id", partitions=5).collect()}
    assert got["a"] == pytest.approx(sil(x[mask], c[mask])) and got["b"] == pytest.approx(sil(x[~mask], c[~mask]))


@pytest.mark.parametrize("dims,chunk", [(1, 7), (3, 4096), (32, 50)])
def test_silhouette_by_blocks_of_dimensions(spark, monkeypatch, dims, chunk):
    """Any block size and chunk gives the brute-force value; rows move once in blocks and once as sums."""
    monkeypatch.setattr(V, "BLOCK_DIMS", dims)
    monkeypatch.setattr(V, "CHUNK_ROWS", chunk)
    x, c = data(400, 3)
    x[:50] = x[50:100]                            # ties
    g = ["a" if i % 4 else "b" for i in range(400)]
    mask = np.array([v == "a" for v in g])
    out = V.silhouette_manhattan(frame(spark, x, c, g), by=["g"], cluster="lang", id="id")
    got = {r["g"]: r["silhouette"] for r in out.collect()}
    assert got["a"] == pytest.approx(sil(x[mask], c[mask])) and got["b"] == pytest.approx(sil(x[~mask], c[~mask]))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and "RepartitionByRange" not in plan and "cogroup" not in plan.lower()


def test_large_groups_go_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_CELLS", 10)
    x, c = data(200, 2)
    got = V.silhouette_manhattan(frame(spark, x, c), by=["g"], cluster="lang", id="id").first()
    assert got["silhouette"] == pytest.approx(sil(x, c))


def test_silhouette_skip_and_resample(spark):
    x, c = data()
    rows = frame(spark, x, c)
    assert V.silhouette_manhattan(rows, by=["g"], cluster="lang", id="id", sample=0).first()["silhouette"] == 0.0
    drawn = V.resample(rows, 40, by=["g"], ids=["id"], seed=42).toPandas()
    assert len(drawn) == 40 and drawn["id"].nunique() < 40
    at = drawn["id"].to_numpy()
    got = V.silhouette_manhattan(rows, by=["g"], cluster="lang", id="id", sample=40).first()["silhouette"]
    assert got == pytest.approx(sil(x[at], c[at]))


def test_degenerate_clusters(spark):
    same = frame(spark, np.ones((6, 2)), np.array([0, 0, 0, 1, 1, 1]))
    got = V.cluster_quality(same, by=["g"], cluster="lang", id="id").first()
    assert (got["davies_bouldin"], got["calinski_harabasz"], got["silhouette"]) == (0.0, 1.0, 0.0)


@pytest.mark.parametrize("shard", [4, 8192])
def test_replicates_equal_metrics_of_the_drawn_rows(spark, shard):
    x, c = data(hot=True)
    rows = frame(spark, x, c)
    drawn = S.replicate_weights(rows, 6, by=["g"], id="id").toPandas().sort_values("id")
    w = np.stack(drawn["w"].to_numpy())
    assert abs(w.mean() - 1) < 0.1 and w.max() >= 3
    got = S.replicate_metrics(rows, 6, by=["g"], cluster="lang", id="id", rows_per_shard=shard).toPandas().set_index("rep")
    for rep in range(6):
        at = np.repeat(drawn["id"].to_numpy(), w[:, rep])
        assert got.loc[rep, "davies_bouldin"] == pytest.approx(db(x[at], c[at]))
        assert got.loc[rep, "calinski_harabasz"] == pytest.approx(ch(x[at], c[at]))


def test_interval_and_test_from_replicates(spark):
    vals = [(m, r, float(v), float(v) * 2) for m, vs in (("xpe", [3, 5, 1]), ("spt", [2, 2, 2])) for r, v in enumerate(vs)]
    metrics = spark.createDataFrame(vals, "method string, rep int, davies_bouldin double, calinski_harabasz double").withColumn("layer", F.lit(0))
    observed = metrics.where("rep = 0").drop("rep")
    ci = {(r["method"], r["metric"]): r for r in S.bootstrap_ci(metrics, ["layer", "method"]).collect()}
    assert ci[("xpe", "db")]["ci_l"] == pytest.approx(np.percentile([3, 5, 1], 2.5))
    assert ci[("xpe", "db")]["se"] == pytest.approx(np.std([3, 5, 1], ddof=1))
    r = S.bootstrap_diff_test(metrics, observed, by=["layer"]).where("metric = 'db'").first()
    assert r["diff"] == 1.0 and r["p"] == pytest.approx((1 + 1) / (3 + 1))
    turned = S.bootstrap_diff_test(metrics, observed, by=["layer"], methods=("spt", "xpe")).where("metric = 'db'").first()
    assert turned["diff"] == -1.0 and turned["p"] == pytest.approx((1 + 1) / (3 + 1))


def test_dispersion_of_large_coordinates(spark):
    rng = np.random.default_rng(9)
    c = np.repeat([0, 1], 200)
    x = 1e5 + 1e-3 * (rng.normal(size=(400, 3)) + 0.8 * c[:, None])
    rows = frame(spark, x, c)
    got = V.calinski_harabasz(rows, by=["g"], cluster="lang").first()["calinski_harabasz"]
    assert got == pytest.approx(ch(x - 1e5, c), rel=1e-6) and got > 10
    rep = S.replicate_metrics(rows, 3, by=["g"], cluster="lang", id="id").toPandas()
    assert (rep["calinski_harabasz"] > 10).all()


def test_mean_interval_covers_the_mean(spark):
    rows = spark.range(500).select("id", F.lit("g").alias("g"), (F.col("id") % 4 == 0).cast("int").alias("hit"))
    r = S.mean_interval(rows, "hit", 200, by=["g"], id="id").first()
    assert r["ci_l"] < 0.25 < r["ci_u"] and r["se"] == pytest.approx(np.sqrt(0.25 * 0.75 / 500), rel=0.2)


def test_medians_skip_unknown_values(spark):
    rows = [(i, "a", float(i) if i else None, float("nan") if i > 5 else 1.0) for i in range(6)] + [(10 + i, "a", None, None) for i in range(4)]
    got = V.group_medians(spark.createDataFrame(rows, "id int, label string, x double, y double"), label="label", axes=["x", "y"], id="id").first()
    assert (got["median_x"], got["median_y"]) == (3.0, 1.0)


def test_repeated_keys_keep_their_rows(spark):
    from glossagrid.operators.ranking import position

    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", 1, "x")], "g string, k int, v string")
    got = position(rows, ["k"], group=["g"]).collect()
    assert sorted((r["g"], r["rank"]) for r in got) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)] and sorted(r["v"] for r in got) == ["x", "x", "y", "z"]


def test_medians_of_a_hot_group(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(501), "label": ["hot"] * 300 + ["b"] * 100 + ["Mixed"] * 101,
                        "x": np.r_[np.zeros(250), rng.normal(size=251)], "y": rng.normal(size=501)})
    got = {r["label"]: r for r in V.group_medians(spark.createDataFrame(pdf), label="label", axes=["x", "y"], id="id").collect()}
    assert set(got) == {"hot", "b"}
    for label in got:
        part = pdf[pdf["label"] == label]
        assert got[label]["median_x"] == pytest.approx(part["x"].median()) and got[label]["median_y"] == pytest.approx(part["y"].median())


def test_projection_has_the_largest_variances(spark):
    x, c = data(200, 6)
    out = V.pca_projection(frame(spark, x, c), 2).select("pc1", "pc2").toPandas()
    top = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]
    assert out.var(ddof=1).to_numpy() == pytest.approx(top) and abs(out.mean().to_numpy()).max() < 1e-9


def test_mask_pads_prompt_positions(spark):
    rows = spark.createDataFrame([(1, [[1.0], [2.0], [3.0], [4.0]], [1, 0])], "id int, states array<array<double>>, mask array<int>")
    assert [(r["pos"], r["state"]) for r in V.mask_filter(rows, prompt_size=2, keep=["id"]).collect()] == [(2, [3.0])]


def hot_rows(spark, n=3000):
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"))


def test_digest_rank_equals_one_sort(spark):
    got = K.digest_rank(hot_rows(spark), ["id"], seed=9, group=["g"], rank="r", total="n").toPandas()
    import hashlib
    got["d"] = [hashlib.md5(f"9|{i}".encode()).hexdigest() for i in got["id"]]
    want = got.groupby("g")["d"].rank().astype(int) - 1
    assert (got["r"] == want).all() and (got["n"] == got.groupby("g")["id"].transform("size")).all()
    assert sorted(K.digest_rank(hot_rows(spark), ["id"], seed=9, rank="r").toPandas()["r"]) == list(range(3000))


def test_sampling_keeps_exact_counts_and_the_lowest_draws(spark):
    got = V.sample_per_group(hot_rows(spark), 0.1, group=["g"], ids=["id"], seed=1).toPandas()
    sizes = hot_rows(spark).toPandas().groupby("g").size()
    assert got.groupby("g").size().to_dict() == {g: int(n * 0.1) for g, n in sizes.items() if int(n * 0.1)}
    ranked = K.digest_rank(hot_rows(spark), ["id"], seed=1, group=["g"], rank="r").toPandas()
    assert set(got["id"]) == set(ranked[ranked["r"] < (ranked.groupby("g")["id"].transform("size") * 0.1).astype(int)]["id"])
    assert V.sample_k(hot_rows(spark), 77, ids=["id"], seed=1).count() == 77
    assert V.sample_k(hot_rows(spark), 9999, ids=["id"], seed=1).count() == 3000


def test_position_and_heads_equal_one_sort(spark):
    rows = hot_rows(spark).withColumn("v", F.col("id") % 7)
    got = K.position(rows.withColumn("w", F.col("id") * 2), ["v", "id"], group=["g"], descending=["v"], partitions=6).toPandas()
    want = got.sort_values(["g", "v", "id"], ascending=[True, False, True]).groupby("g").cumcount()
    assert len(got) == 3000 and (got["rank"] == want.sort_index()).all()
    heads = V.preview(rows, 100, group=["g"], order=["id"]).toPandas()
    k = 100 // rows.select("g").distinct().count()
    full = rows.toPandas().sort_values("id").groupby("g").head(k)
    assert set(heads["id"]) == set(full["id"])


def test_rows_of_a_null_group_are_ranked_and_sampled(spark):
    rows = spark.range(50).select("id", F.when(F.col("id") % 2 == 0, "g").alias("g"))
    assert sorted(K.digest_rank(rows, ["id"], seed=1, group=["g"], rank="r").where("g is null").toPandas()["r"]) == list(range(25))
    assert K.position(rows, ["id"], group=["g"]).where("g is null").count() == 25
    assert V.sample_per_group(rows, 0.2, group=["g"], ids=["id"], seed=1).where("g is null").count() == 5


def test_draws_are_uniform(spark):
    u = spark.range(4000).select(draws.draw_unit("s", "id").alias("u")).toPandas()["u"]
    assert 0.47 < u.mean() < 0.53 and u.between(0, 1, inclusive="left").all()
