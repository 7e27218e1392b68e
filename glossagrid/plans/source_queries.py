"""Queries over readers and writers; their files are written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import folds
from ..session import scratch_path
from ..sources import datasets as D, embeddings as E, results as R
from . import bindings as B
from .registry import query
from .result_queries import SOURCE_VIEWS, rounded

FILES = ("part-*.csv",)


def _run_files(spark, d) -> str:
    """Result files in two layouts: named columns, and legacy rows known by run name."""
    root = scratch_path(spark, "runs")
    rows = B.result_rows(spark, d).withColumn(
        "run", F.concat(F.lit("20260101_120000_"), "method", F.lit("_f"), "fold", F.lit("_s"), "seed"))
    rows.where("method <> 'R'").select(
        "method", "seed", "fold", "llm", F.col("target_lang").alias("metric_group"), "accuracy", "n", "run").write.partitionBy(
        "run").option("header", "true").csv(f"{root}/new")
    rows.where("method = 'R'").select(
        F.col("run").alias("run_name"), F.lit("core").alias("src_tag"), "fold", "seed", "target_lang", "accuracy",
        "n", F.lit("base").alias("llm"), "run").write.partitionBy("run").option("header", "true").csv(f"{root}/old")
    return root


@query("collect_results", """
SELECT method, seed, fold, target_lang, round(accuracy, 6) AS accuracy, n, llm,
       CASE WHEN method = 'R' THEN 'core' END AS source_group FROM result_rows""", "result_rows")
def collect_results(spark, d):
    rows = R.collect_results(spark, _run_files(spark, d), patterns=FILES)
    return rounded(rows.select("method", "seed", "fold", "target_lang", "accuracy", "n", "llm", "source_group"), "accuracy")


@query("normalize_results", """
SELECT method, seed, fold, target_lang, round(accuracy, 6) AS accuracy, n, llm, 'core' AS source_group,
       '20260101_120000_' || method || '_f' || fold AS run_name FROM result_rows""", "result_rows")
def normalize_results(spark, d):
    raw = B.result_rows(spark, d).select(
        F.concat(F.lit("20260101_120000_"), "method", F.lit("_f"), "fold").alias("name"), F.lit("core").alias("src_tag"),
        F.col("target_lang").alias("metric_group"), F.col("seed").cast("string"), F.concat("fold", F.lit(".0")).alias("fold"),
        F.col("accuracy").cast("string"), F.col("n").cast("string"))
    return rounded(R.normalize(raw, backbone="base"), "accuracy")


@query("scan_with_path_columns", """
SELECT grid, source_group, target_lang, CAST(seen AS BIGINT) AS seen, perf, round("A_acc", 6) AS "A_acc", round("A_std", 6) AS "A_std", n_seeds
FROM source_tables""", SOURCE_VIEWS)
def scan_with_path_columns(spark, d):
    root = scratch_path(spark, "tables")
    tables = B.source_tables(spark, d)
    # Each language table, and a baseline folder that the scan must skip.
    folders = F.array(F.concat_ws(".", "grid", "source_group"), F.concat(F.col("grid"), F.lit(".zero")))
    tables.withColumn("folder", F.explode(folders)).withColumn("table", F.lit("lang_table.csv")).drop(
        "grid", "source_group").write.partitionBy("folder", "table").option("header", "true").csv(root)
    rows = R.scan_tables(spark, root)
    return rounded(rows.select(
        "grid", "source_group", "target_lang", "seen", "perf", "A_acc", "A_std", "n_seeds"), "A_acc", "A_std")


def _foldered(spark, d):
    return B.topic_src(spark, d).withColumn("fold", (F.col("index_id") % 3).cast("int"))


@query("discover_partitions", """
SELECT DISTINCT lang, CAST(index_id % 3 AS VARCHAR) AS fold, split FROM topic_src""", "topic_src")
def discover_partitions(spark, d):
    root = scratch_path(spark, "parts")
    D.write_partitioned(_foldered(spark, d), root)
    return D.discover_partitions(spark, root)


@query("write_partitioned_verified", """
SELECT lang, CAST(index_id % 3 AS VARCHAR) AS fold, split, count(*) AS n_expected, count(*) AS n_written, true AS ok
FROM topic_src GROUP BY ALL""", "topic_src")
def write_partitioned_verified(spark, d):
    return D.write_verified(_foldered(spark, d), scratch_path(spark, "verified"))


@query("incremental_skip_existing", """
SELECT 'first' AS step, lang, split, count(*) AS n_rows FROM topic_src WHERE lang NOT IN ('en', 'fr') GROUP BY ALL
UNION ALL SELECT 'stored', lang, split, count(*) FROM topic_src GROUP BY ALL""", "topic_src")
def incremental_skip_existing(spark, d):
    root, parts = scratch_path(spark, "incremental"), ("lang", "split")
    rows = B.topic_src(spark, d)
    D.write_partitioned(rows.where(F.col("lang").isin("en", "fr")), root, parts)
    first = D.append_missing(rows, root, parts).withColumn("step", F.lit("first"))
    second = D.append_missing(rows, root, parts).withColumn("step", F.lit("second"))
    stored = D.partition_counts(spark.read.parquet(root), parts).withColumn("step", F.lit("stored"))
    return first.unionByName(second).unionByName(stored)


@query("dataset_manifest", """
SELECT lang AS config_name, CAST(to_json(list({'split': split, 'path': lang || '/' || split || '-*', 'n_rows': n} ORDER BY split)) AS VARCHAR) AS data_files,
       'cc-by-sa-4.0' AS license
FROM (SELECT lang, split, count(*) AS n FROM topic_src GROUP BY ALL) GROUP BY lang""", "topic_src")
def dataset_manifest(spark, d):
    return D.manifest(B.topic_src(spark, d), header={"license": "cc-by-sa-4.0"})


@query("metrics_map_to_table", """
SELECT method, target_lang AS language, 'belebele_' || target_lang AS task, round(sum(accuracy * n) / sum(n), 6) AS acc,
       CAST(sum(n) AS DOUBLE) AS n
FROM result_rows GROUP BY ALL""", "result_rows")
def metrics_map_to_table(spark, d):
    cells = B.result_rows(spark, d).groupBy("method", "target_lang").agg(
        F.round(F.sum(F.col("accuracy") * F.col("n")) / F.sum("n"), 6).alias("acc"), F.sum("n").cast("double").alias("n"))
    entry = F.struct(
        F.concat(F.lit("belebele_"), "target_lang"),
        F.create_map(F.lit("acc,none"), F.col("acc"), F.lit("n,none"), F.col("n")))
    # One document per method; its entries are the languages.
    documents = cells.groupBy("method").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("metrics"))
    return R.metrics_table(documents, metrics=["acc", "n"], keep=["method"])


@query("load_embeddings", "SELECT key, count(*) AS n_rows, CAST(max(len(embedding)) AS INTEGER) AS width FROM emb GROUP BY key", "emb")
def load_embeddings(spark, d):
    root = scratch_path(spark, "store")
    B.emb(spark, d).select("key", "embedding").write.parquet(root)
    return E.key_counts(E.load_embeddings(spark, root))


@query("merge_shards", """
SELECT key, vec_id AS row_id, CAST(shard AS INTEGER) AS shard, CAST(dense_rank() OVER (ORDER BY first, key) - 1 AS INTEGER) AS key_order
FROM (SELECT key, vec_id, CASE WHEN label < 6 AND vec_id % 3 > 0 THEN 1 ELSE 2 END AS shard,
             min(CASE WHEN label < 6 AND vec_id % 3 > 0 THEN 1 ELSE 2 END) OVER (PARTITION BY key) AS first FROM emb)""", "emb")
def merge_shards(spark, d):
    rows = B.emb(spark, d).select("key", F.col("vec_id").alias("row_id"), "label")
    mine = (F.col("label") < 6) & (F.col("row_id") % 3 > 0)
    return E.merge_shards(rows.where(mine).drop("label"), rows.where(~mine).drop("label"))


@query("select_embeddings", """
SELECT key, vec_id FROM emb WHERE key LIKE '%xpe%' AND key LIKE '%low-perf%' AND (key LIKE '%@1%' OR key LIKE '%@2%')""", "emb")
def select_embeddings(spark, d):
    return E.select_embeddings(
        B.emb(spark, d), model="xpe", group="low-perf", layers=["@1", "@2"]).select("key", "vec_id")


@query("parse_embedding_key", """
SELECT vec_id, key, lang, layer, method = 'xpe' AS is_xpe, method = 'spt' AS is_spt FROM emb""", "emb")
def parse_embedding_key(spark, d):
    key = F.col("key")
    return B.emb(spark, d).select(
        "vec_id", "key", N.lang_of_key(key).alias("lang"), N.layer_of_key(key).alias("layer"),
        N.has_method(key, "xpe").alias("is_xpe"), N.has_method(key, "spt").alias("is_spt"))


@query("script_of", """
SELECT code, CASE WHEN code LIKE '%\\_%' ESCAPE '\\' AND regexp_matches(split_part(code, '_', -1), '^\\p{L}{4}$') THEN split_part(code, '_', -1) ELSE code END AS script,
       CASE WHEN code NOT LIKE '%\\_%' ESCAPE '\\' THEN 'UNK' WHEN code[strpos(code, '_') + 1:] = 'Latn' THEN code
            ELSE code[strpos(code, '_') + 1:] END AS vocabulary_script
FROM (SELECT DISTINCT replace(o_orderpriority, '-', '_') || CASE WHEN o_orderkey % 4 = 0 THEN '_Latn' WHEN o_orderkey % 4 = 1 THEN '_Cyr'
             WHEN o_orderkey % 4 = 2 THEN '_Äthi' ELSE '' END AS code FROM orders)""")
def script_of(spark, d):
    tail = F.element_at(F.array(*[F.lit(s) for s in ("_Latn", "_Cyr", "_Äthi", "")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    codes = B.table(spark, d, "orders").select(
        F.concat(F.replace("o_orderpriority", F.lit("-"), F.lit("_")), tail).alias("code")).distinct()
    return codes.select("code", N.script_of(F.col("code")).alias("script"),
                        N.vocabulary_script(F.col("code")).alias("vocabulary_script"))


@query("parse_run_name", """
SELECT DISTINCT '20260101_120000_' || method || '_f' || fold || '_s' || seed AS run, method || '_f' || fold || '_s' || seed AS label, method,
       CASE WHEN seed > 1 THEN fold END AS fold, CASE WHEN seed % 2 = 0 THEN 'high-perf' ELSE 'core' END AS source
FROM result_rows""", "result_rows")
def parse_run_name(spark, d):
    runs = B.result_rows(spark, d).select("method", "seed", "fold").distinct().select(
        F.concat(F.lit("20260101_120000_"), "method", F.lit("_f"), "fold", F.lit("_s"), "seed").alias("run"),
        F.when(F.col("seed") > 1, F.concat(F.lit("data/en/fold"), "fold", F.lit("/tok"))).otherwise("data/en/tok").alias("dirs"),
        F.when(F.col("seed") % 2 == 0, "base_high").otherwise("core").alias("source"))
    return runs.select(
        "run", N.run_label(F.col("run")).alias("label"), N.method_of_run(F.col("run")).alias("method"),
        N.fold_of_path(F.col("dirs")).alias("fold"), N.source_label(F.col("source")).alias("source"))


@query("select_partition", """
SELECT index_id, split FROM topic_src WHERE lang = 'fr' AND index_id % 3 = 2""", "topic_src")
def select_partition(spark, d):
    root = scratch_path(spark, "pruned")
    D.write_partitioned(_foldered(spark, d), root)
    return folds.select_partition(spark.read.parquet(root), lang="fr", fold=2).select("index_id", "split")
