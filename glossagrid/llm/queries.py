"""One query per operator over the whole `documents` table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import settle
from . import bitplanes, bytenet, fingerprints, lshforest, packing, pitmanyor, runs, secrets, sharding, spelling, templates, toxicity, warc
from .base import default_tokenizer, fold, table, whole

QUERIES, ORACLES = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


@query
def op5_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    scanned = settle(scanned.select("doc_id", "base", "candidates"))
    found = secrets.with_spans(scanned, secrets.discovery_bin(scanned))
    count = [secrets.count_kind(F.col("base"), k).cast("bigint").alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *count, F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"),
                        secrets.span_text(F.col("spans")).alias("spans"))


@query
def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = whole(F.col("text"))
    records = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))
    placed = sharding.shard_by_size(records, 8, "key", "size")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bitplanes.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer())
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))


@query
def op10_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer())
    return packed.select("doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"),
                         F.crc32("ids").alias("ids_crc32"), "sequence_id", F.col("offset").cast("bigint").alias("offset"))


@query
def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query
def op2_nearest_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@query
def op7_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = bytenet.score_documents(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 10) == 0
    scored = pitmanyor.score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_multiscale_minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", runs.planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.periodic_runs(docs)
    best = runs.longest_run(F.col("runs"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(runs.run_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_variable_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op13_splittable_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select(warc.row_id(F.col("record_id")).alias("page_id"), "payload_bytes", F.substring("payload_digest", 6, 32).alias("payload_digest"),
                       F.col("type").alias("record_type"), warc.row_id(F.col("refers_to")).alias("refers_to"))


# DuckDB has no crc32 and measures edits in bytes: the table of crc32 comes from its rule, and words one
# edit apart share the rest when one character each is taken away at the same place, or one is
# the other less a character.
ORACLES["op12_variable_grams"] = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                          lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) t(i))),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{6,}')) AS run FROM documents) GROUP BY ALL),
coded AS (
  SELECT run, times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(range(1, length(x)::BIGINT, 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))) AS h
  FROM coded, crc_table),
vocabulary AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
shorter AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM vocabulary, LATERAL (SELECT unnest(range(length(word))) AS i)),
pairs AS (
  SELECT x.word, x.n, y.word AS other, y.n AS m FROM shorter x JOIN shorter y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM shorter x JOIN vocabulary y ON x.rest = y.word
  UNION SELECT y.word, y.n, x.word, x.n FROM shorter x JOIN vocabulary y ON x.rest = y.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
near AS (SELECT word, n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM ranked WHERE r = 1),
paths AS (
  SELECT word, form AS reached, 1 AS steps FROM near WHERE form IS NOT NULL
  UNION ALL SELECT p.word, f.form, p.steps + 1 FROM paths p JOIN near f ON p.reached = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(reached, steps) AS root FROM paths GROUP BY word)
SELECT v.word, near.form, coalesce(ends.root, v.word) AS root, v.n, coalesce(near.n_near, 0)::BIGINT AS n_near, near.form_n
FROM vocabulary v LEFT JOIN near ON v.word = near.word LEFT JOIN ends ON v.word = ends.word"""

ORACLES["op13_splittable_reader"] = """
WITH hashed AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM hashed)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, 1 + 10 * (k // 8), 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::BIGINT + 1, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts"""
