"""Queries over embeddings: selection, cluster quality, bootstrap, projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap as S, vectors as V
from . import bindings as B
from .registry import query, view
from .result_queries import rounded

BY = ["layer", "method"]
REPLICATES = 1000


def _rows(spark, d):
    return B.emb(spark, d).select(*BY, "lang", "vec_id", "embedding")


view("masked", """
  SELECT vec_id, pos, embedding[pos * 4 + 1 : pos * 4 + 4] AS state
  FROM emb, (SELECT unnest(range(16)) AS pos)
  WHERE pos >= 4 AND (vec_id + pos - 4) % 3 > 0
""")


@query("mask_filter", """
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(list_sum(state), 6) AS total FROM masked""", "emb masked")
def mask_filter(spark, d):
    # A vector as 16 states of width 4; the first four are prompt positions.
    states = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    mask = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when((F.col("vec_id") + i) % 3 > 0, 1).otherwise(0))
    rows = B.emb(spark, d).select("vec_id", states.alias("states"), mask.alias("mask"))
    kept = V.mask_filter(rows, prompt_size=4, keep=["vec_id"])
    return rounded(kept.select("vec_id", "pos", F.aggregate("state", F.lit(0.0), lambda a, x: a + x).alias("total")), "total")


@query("sample_per_group", """
SELECT key, vec_id FROM (SELECT key, vec_id, row_number() OVER (PARTITION BY key ORDER BY md5('5|' || vec_id)) AS r,
                                count(*) OVER (PARTITION BY key) AS n FROM emb)
WHERE r <= floor(n * 0.2)""", "emb")
def sample_per_group(spark, d):
    return V.sample_per_group(B.emb(spark, d).select("key", "vec_id"), 0.2, group=["key"], ids=["vec_id"], seed=5)


@query("head_per_group", """
SELECT key, vec_id FROM (SELECT key, vec_id, row_number() OVER (PARTITION BY key ORDER BY vec_id) AS r FROM emb)
WHERE r <= greatest(1, 120 // (SELECT count(DISTINCT key) FROM emb))""", "emb")
def head_per_group(spark, d):
    return V.preview(B.emb(spark, d).select("key", "vec_id"), 120, group=["key"], order=["vec_id"])


view("coords", """
  SELECT layer, method, lang, vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim, unnest(embedding) AS x FROM emb
""")
view("cluster_n", "SELECT layer, method, lang, count(*) AS n FROM emb GROUP BY ALL")
view("mu", "SELECT layer, method, lang, dim, avg(x) AS m FROM coords GROUP BY ALL")
view("spread", """
  SELECT layer, method, lang, avg(dist) AS s
  FROM (SELECT layer, method, lang, vec_id, sqrt(sum((x - m) * (x - m))) AS dist
        FROM coords JOIN mu USING (layer, method, lang, dim) GROUP BY ALL)
  GROUP BY ALL
""")
view("db", """
  SELECT layer, method, avg(worst) AS davies_bouldin
  FROM (SELECT p.layer, p.method, p.la, max((a.s + b.s) / p.gap) AS worst
        FROM (SELECT a.layer, a.method, a.lang AS la, b.lang AS lb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS gap
              FROM mu a JOIN mu b ON a.layer = b.layer AND a.method = b.method AND a.dim = b.dim AND a.lang <> b.lang
              GROUP BY ALL) p
        JOIN spread a ON a.layer = p.layer AND a.method = p.method AND a.lang = p.la
        JOIN spread b ON b.layer = p.layer AND b.method = p.method AND b.lang = p.lb
        GROUP BY ALL)
  GROUP BY ALL
""")
view("ch", """
  SELECT layer, method, (b / (k - 1)) / (w / (n - k)) AS calinski_harabasz, n AS n_samples, k AS n_clusters
  FROM (SELECT layer, method, sum((x - m) * (x - m)) AS w, sum((m - g) * (m - g)) AS b
        FROM coords JOIN mu USING (layer, method, lang, dim)
        JOIN (SELECT layer, method, dim, avg(x) AS g FROM coords GROUP BY ALL) USING (layer, method, dim) GROUP BY ALL)
  JOIN (SELECT layer, method, CAST(sum(n) AS BIGINT) AS n, count(*) AS k FROM cluster_n GROUP BY ALL) USING (layer, method)
""")
view("sil", """
  SELECT layer, method, avg(CASE WHEN own = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette
  FROM (SELECT layer, method, vec_id, max(n) FILTER (same) AS own, max(total / (n - 1)) FILTER (same AND n > 1) AS a,
               min(total / n) FILTER (NOT same) AS b
        FROM (SELECT p.layer, p.method, p.vec_id, p.lang = q.lang AS same, max(c.n) AS n,
                     sum(list_sum(list_transform(list_zip(p.embedding, q.embedding), lambda z: abs(z[1] - z[2])))) AS total
              FROM emb p JOIN emb q ON p.layer = q.layer AND p.method = q.method
              JOIN cluster_n c ON c.layer = q.layer AND c.method = q.method AND c.lang = q.lang
              GROUP BY p.layer, p.method, p.vec_id, p.lang, q.lang)
        GROUP BY ALL)
  GROUP BY ALL
""")


@query("davies_bouldin", "SELECT layer, method, round(davies_bouldin, 6) AS davies_bouldin FROM db", "emb coords mu spread db")
def davies_bouldin(spark, d):
    return rounded(V.davies_bouldin(_rows(spark, d), by=BY, cluster="lang"), "davies_bouldin")


@query("calinski_harabasz", """
SELECT layer, method, round(calinski_harabasz, 6) AS calinski_harabasz, n_samples, n_clusters FROM ch""", "emb coords cluster_n mu ch")
def calinski_harabasz(spark, d):
    return rounded(V.calinski_harabasz(_rows(spark, d), by=BY, cluster="lang"), "calinski_harabasz")


@query("silhouette_manhattan", "SELECT layer, method, round(silhouette, 6) AS silhouette FROM sil", "emb cluster_n sil")
def silhouette_manhattan(spark, d):
    return rounded(V.silhouette_manhattan(_rows(spark, d), by=BY, cluster="lang", id="vec_id"), "silhouette")


_FIELDS = ["silhouette", "davies_bouldin", "calinski_harabasz"]


@query("method_diff", f"""
SELECT layer, {", ".join(f"round(max({f}) FILTER (method = '{m}'), 6) AS {m}_{f}" for f in _FIELDS for m in ("xpe", "spt"))},
       {", ".join(f"max({f}) FILTER (method = '{m}') AS {m}_{f}" for f in ("n_samples", "n_clusters") for m in ("xpe", "spt"))},
       {", ".join(f"round(max({f}) FILTER (method = 'xpe') - max({f}) FILTER (method = 'spt'), 6) AS diff_{f}" for f in _FIELDS)}
FROM sil JOIN db USING (layer, method) JOIN ch USING (layer, method) GROUP BY layer""",
       "emb coords cluster_n mu spread db ch sil")
def method_diff(spark, d):
    quality = V.cluster_quality(_rows(spark, d), by=BY, cluster="lang", id="vec_id")
    wide = V.method_diff(quality, by=["layer"])
    return rounded(wide, *[f"{p}_{f}" for p in ("xpe", "spt", "diff") for f in _FIELDS])


view("weights", f"""
  SELECT layer, method, lang, vec_id, embedding, rep, {" + ".join(f"CAST(u >= {t!r} AS INTEGER)" for t in S.POISSON)} AS w
  FROM (SELECT *, ('0x' || md5('42|' || layer || '|' || method || '|' || rep || '|' || vec_id)[1:15])::BIGINT / 1152921504606846976.0::DOUBLE AS u
        FROM emb, (SELECT unnest(range({REPLICATES})) AS rep))
""")
view("drawn", "SELECT * FROM weights WHERE w > 0")
view("rmu", """
  SELECT rep, layer, method, lang, dim, sum(w * x) / sum(w) AS m, sum(w) AS n
  FROM (SELECT rep, layer, method, lang, w, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM drawn) GROUP BY ALL
""")
view("raway", """
  SELECT d.rep, d.layer, d.method, d.lang, d.w, list_sum(list_transform(list_zip(d.embedding, c.center), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS sq
  FROM drawn d JOIN (SELECT rep, layer, method, lang, list(m ORDER BY dim) AS center FROM rmu GROUP BY ALL) c USING (rep, layer, method, lang)
""")
view("rspread", """
  SELECT rep, layer, method, lang, sum(w * sqrt(sq)) / sum(w) AS s, sum(w * sq) AS sq, sum(w) AS n FROM raway GROUP BY ALL
""")
view("rdb", """
  SELECT rep, layer, method, avg(worst) AS value
  FROM (SELECT p.rep, p.layer, p.method, p.la, max((a.s + b.s) / p.gap) AS worst
        FROM (SELECT a.rep, a.layer, a.method, a.lang AS la, b.lang AS lb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS gap
              FROM rmu a JOIN rmu b ON a.rep = b.rep AND a.layer = b.layer AND a.method = b.method AND a.dim = b.dim AND a.lang <> b.lang
              GROUP BY ALL) p
        JOIN rspread a ON a.rep = p.rep AND a.layer = p.layer AND a.method = p.method AND a.lang = p.la
        JOIN rspread b ON b.rep = p.rep AND b.layer = p.layer AND b.method = p.method AND b.lang = p.lb
        GROUP BY ALL)
  GROUP BY ALL
""")
view("rch", """
  SELECT rep, layer, method, (b / (k - 1)) / (w / (n - k)) AS value
  FROM (SELECT rep, layer, method, sum(n * (m - g) * (m - g)) AS b
        FROM rmu JOIN (SELECT rep, layer, method, dim, sum(n * m) / sum(n) AS g FROM rmu GROUP BY ALL) USING (rep, layer, method, dim) GROUP BY ALL)
  JOIN (SELECT rep, layer, method, sum(sq) AS w, sum(n) AS n, count(*) AS k FROM rspread GROUP BY ALL) USING (rep, layer, method)
""")
view("reps", """
  SELECT rep, layer, method, 'db' AS metric, value FROM rdb UNION ALL SELECT rep, layer, method, 'ch', value FROM rch
""")
REPLICATE_VIEWS = "emb weights drawn rmu raway rspread rdb rch reps"


@query("bootstrap_ci", """
SELECT layer, method, metric, round(quantile_cont(value, 0.025), 5) AS ci_l, round(quantile_cont(value, 0.975), 5) AS ci_u,
       round(stddev_samp(value), 5) AS se FROM reps GROUP BY ALL""", REPLICATE_VIEWS)
def bootstrap_ci(spark, d):
    metrics = S.replicate_metrics(_rows(spark, d), REPLICATES, by=BY, cluster="lang", id="vec_id")
    return rounded(S.bootstrap_ci(metrics, BY), "ci_l", "ci_u", "se", digits=5)


@query("bootstrap_diff_test", """
SELECT layer, metric, round(max(o), 5) AS diff, round(quantile_cont(v, 0.025), 5) AS ci_l, round(quantile_cont(v, 0.975), 5) AS ci_u,
       round(stddev_samp(v), 5) AS se, round((count(*) FILTER (CASE WHEN o > 0 THEN v <= 0 ELSE v >= 0 END) + 1) / (count(*) + 1), 5) AS p
FROM (SELECT rep, layer, metric, max(value) FILTER (method = 'xpe') - max(value) FILTER (method = 'spt') AS v FROM reps GROUP BY ALL)
JOIN (SELECT layer, 'db' AS metric, max(davies_bouldin) FILTER (method = 'xpe') - max(davies_bouldin) FILTER (method = 'spt') AS o FROM db GROUP BY layer
      UNION ALL SELECT layer, 'ch', max(calinski_harabasz) FILTER (method = 'xpe') - max(calinski_harabasz) FILTER (method = 'spt') FROM ch GROUP BY layer)
USING (layer, metric) GROUP BY ALL""", REPLICATE_VIEWS + " coords cluster_n mu spread db ch")
def bootstrap_diff_test(spark, d):
    rows = _rows(spark, d)
    metrics = S.replicate_metrics(rows, REPLICATES, by=BY, cluster="lang", id="vec_id")
    observed = V.davies_bouldin(rows, by=BY, cluster="lang").join(V.calinski_harabasz(rows, by=BY, cluster="lang"), BY)
    return rounded(S.bootstrap_diff_test(metrics, observed, by=["layer"]), "diff", "ci_l", "ci_u", "se", "p", digits=5)


@query("group_medians", """
SELECT lang, round(median(embedding[1]), 6) AS median_x, round(median(embedding[2]), 6) AS median_y FROM emb GROUP BY lang""", "emb")
def group_medians(spark, d):
    points = B.emb(spark, d).select("lang", "vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return rounded(V.group_medians(points, label="lang", axes=["x", "y"], id="vec_id"), "median_x", "median_y")


@query("pca_moments", """
SELECT count(*) AS n, 0.0::DOUBLE AS mean1, 0.0::DOUBLE AS mean2, 0.0::DOUBLE AS cross_moment, true AS in_order, true AS within_total
FROM emb WHERE method IN ('spt', 'xpe')""", "emb")
def pca_moments(spark, d):
    """What holds for any right projection: centred, uncorrelated, in order of variance, of no more variance than the vectors."""
    rows = B.emb(spark, d).where("method in ('spt', 'xpe')")
    found = V.pca_projection(rows, 2).agg(
        F.count(F.lit(1)).alias("n"), F.avg("pc1").alias("mean1"), F.avg("pc2").alias("mean2"), F.covar_pop("pc1", "pc2").alias("cross_moment"),
        F.var_pop("pc1").alias("v1"), F.var_pop("pc2").alias("v2"))
    total = rows.select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.var_pop("x").alias("v")).agg(F.sum("v").alias("total"))
    # Two single rows put side by side.
    both = found.unionByName(total, allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    zero = {c: F.round(F.abs(c), 6) for c in ("mean1", "mean2", "cross_moment")}
    return both.withColumns(zero).select(
        "n", *zero, (F.col("v1") >= F.col("v2")).alias("in_order"), (F.col("v1") + F.col("v2") <= F.col("total")).alias("within_total"))


@query("pca_projection")
def pca_projection(spark, d):
    rows = B.emb(spark, d)
    stacked = V.stack_sources(rows.where("method = 'spt'"), rows.where("method = 'xpe'"))
    return rounded(V.pca_projection(stacked, 2).select("vec_id", "side", "pc1", "pc2"), "pc1", "pc2")
