"""Queries over benchmark records: prompts, folds, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CHAT_LAYOUTS
from ..functions.draws import draw_int
from ..operators import folds, prompts, ranking, tokens
from ..session import spread
from . import bindings as B
from .registry import query, view
from .result_queries import rounded

view("mcqa", """
  SELECT lang, item, link, question_number,
         'P: ' || flores_passage || chr(10) || 'Q: ' || stripped_question || chr(10) || 'A: ' || mc_answer1 || chr(10) ||
         'B: ' || mc_answer2 || chr(10) || 'C: ' || mc_answer3 || chr(10) || 'D: ' || mc_answer4 || chr(10) || 'Answer：' AS text,
         ['A', 'B', 'C', 'D'][correct] AS answer_label
  FROM mcqa_src
""")


@query("mcqa_reframe", "SELECT lang, link, question_number, text, answer_label FROM mcqa", "mcqa_src mcqa")
def mcqa_reframe(spark, d):
    return prompts.reframe_mcqa(B.mcqa_src(spark, d))


@query("cloze_reframe", """
SELECT lang, item, s1 || chr(10) || s2 || chr(10) || s3 || chr(10) || s4 || chr(10) || chr(10) ||
       l[1] || ': ' || q1 || chr(10) || l[2] || ': ' || q2 || chr(10) || 'Answer：' AS text, l[ending] AS answer_label
FROM (SELECT *, list_transform(list_sort([md5('7|' || item || '|' || x) || x FOR x IN ['A', 'B', 'C', 'D']]), lambda s: s[33]) AS l
      FROM cloze_src)""", "cloze_src")
def cloze_reframe(spark, d):
    return prompts.reframe_cloze(B.cloze_src(spark, d), seed=7)


@query("positional_question_id", """
SELECT lang, split, index_id, row_number() OVER (PARTITION BY lang, split ORDER BY index_id // 10, index_id % 10) - 1 AS question_id
FROM topic_src""", "topic_src")
def positional_question_id(spark, d):
    rows = B.topic_src(spark, d).select(
        "lang", "split", "index_id", F.floor(F.col("index_id") / 10).alias("link"),
        (F.col("index_id") % 10).alias("question_number"))
    return prompts.question_ids(rows).select("lang", "split", "index_id", "question_id")


@query("chat_wrap", """
SELECT item, layout, opening || CASE WHEN prefill THEN rtrim(text[:length(text) - 7], chr(10)) ELSE text END || closing AS text, answer_label
FROM mcqa, (VALUES
  ('gemma', '<start_of_turn>user' || chr(10), '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10), false),
  ('gemma4', '<|turn>user' || chr(10), '<turn|>' || chr(10) || '<|turn>model' || chr(10) || '<|channel>thought' || chr(10) || '<channel|>', false),
  ('gemma4_prefill', '<|turn>user' || chr(10), '<turn|>' || chr(10) || '<|turn>model' || chr(10) || '<|channel>thought' || chr(10) || '<channel|>Answer：', true),
  ('gemma_prefill', '<start_of_turn>user' || chr(10), '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) || 'Answer：', true)
) AS t(layout, opening, closing, prefill)""", "mcqa_src mcqa")
def chat_wrap(spark, d):
    from ..functions.text import chat_text
    plain = prompts.reframe_mcqa(B.mcqa_src(spark, d), keep=["item"])
    # All layouts in one pass over the prompts.
    wrapped = F.array(*[F.struct(F.lit(x).alias("layout"), chat_text(F.col("text"), x).alias("text")) for x in CHAT_LAYOUTS])
    return plain.select("item", "answer_label", F.explode(wrapped).alias("w")).select("item", "w.layout", "w.text", "answer_label")


@query("label_encode", """
SELECT lang, split, index_id, CAST(index_id % 7 AS INTEGER) AS labels, text AS inputs FROM topic_src""", "topic_src")
def label_encode(spark, d):
    return prompts.label_topics(B.topic_src(spark, d))


@query("split_remap", """
SELECT lang, CASE split WHEN 'train' THEN 'validation' ELSE 'train' END AS split, index_id
FROM topic_src WHERE split IN ('train', 'validation')""", "topic_src")
def split_remap(spark, d):
    return prompts.remap_splits(
        B.topic_src(spark, d), {"train": "validation", "validation": "train"}).select("lang", "split", "index_id")


view("gappy", """
  SELECT * FROM parallel_items WHERE NOT (lang = 'es' AND CAST(link AS BIGINT) % 7 = 3 AND question_number = 1)
  UNION ALL SELECT 'fr', 'extra', CAST(0 AS INTEGER)
""")


def _gappy(spark, d):
    """Parallel items where one language lacks keys and one has a key of its own."""
    items = B.parallel_items(spark, d)
    hole = (F.col("lang") == "es") & (F.col("link").cast("bigint") % 7 == 3) & (F.col("question_number") == 1)
    extra = B.table(spark, d, "region").agg(F.min("r_regionkey").alias("k")).select(
        F.lit("fr").alias("lang"), F.lit("extra").alias("link"), F.col("k").cast("int").alias("question_number"))
    return items.where(~hole).unionByName(extra)


@query("parallel_key_check", """
SELECT lang, count(*) FILTER (i.k IS NULL) AS n_missing, CAST(0 AS BIGINT) AS n_extra, count(*) FILTER (i.k IS NULL) = 0 AS ok
FROM (SELECT DISTINCT lang FROM gappy) l CROSS JOIN (SELECT DISTINCT link, question_number FROM gappy WHERE lang = 'de') r
LEFT JOIN (SELECT DISTINCT lang, link, question_number, 1 AS k FROM gappy) i USING (lang, link, question_number)
WHERE lang <> 'fr' GROUP BY lang
UNION ALL SELECT 'fr', 0, 1, false""", "parallel_items gappy")
def parallel_key_check(spark, d):
    return folds.parallel_report(_gappy(spark, d))


view("folded", """
  SELECT link, question_number, f AS fold,
         CASE WHEN r // (n // 5) = f THEN 'test'
              WHEN r - CASE WHEN r >= (f + 1) * (n // 5) THEN n // 5 ELSE 0 END < n // 10 THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT link, question_number, row_number() OVER (ORDER BY md5('11|' || link || '|' || question_number)) - 1 AS r, count(*) OVER () AS n
        FROM (SELECT DISTINCT link, question_number FROM parallel_items)),
       (SELECT CAST(unnest(range(5)) AS INTEGER) AS f)
""")


@query("fold_split", "SELECT lang, link, question_number, fold, split FROM parallel_items JOIN folded USING (link, question_number)",
       "parallel_items folded")
def fold_split(spark, d):
    items = B.parallel_items(spark, d)
    return folds.fold_rows(items, folds.fold_plan(items, n_splits=5, val_share=10, seed=11))


@query("concat_with_task_ids", """
SELECT lang, split, index_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS task_ids FROM topic_src""", "topic_src")
def concat_with_task_ids(spark, d):
    return folds.task_ids(B.topic_src(spark, d)).select("lang", "split", "index_id", "task_ids")


view("tokenized", r"""
  SELECT doc_id, lang, len(regexp_extract_all(text, '\S+')) + 2 AS length FROM documents
""")


def _tokenized(spark, d, **options):
    return tokens.tokenize(spread(B.table(spark, d, "documents")), tokens.pattern_tokenizer(), max_length=1024, **options)


@query("tokenize_lengths", """
SELECT doc_id, lang, CAST(length AS INTEGER) AS length, length > 1024 AS too_long FROM tokenized""", "tokenized")
def tokenize_lengths(spark, d):
    return _tokenized(spark, d).select("doc_id", "lang", "length", "too_long")


@query("length_stats", """
SELECT lang, count(*) AS n, CAST(min(length) AS INTEGER) AS min_length, round(avg(length), 6) AS mean_length,
       round(quantile_cont(length, 0.5), 6) AS p50, round(quantile_cont(length, 0.9), 6) AS p90,
       round(quantile_cont(length, 0.95), 6) AS p95, round(quantile_cont(length, 0.99), 6) AS p99,
       CAST(max(length) AS INTEGER) AS max_length, count(*) FILTER (length > 1024) AS n_too_long
FROM tokenized GROUP BY lang""", "tokenized")
def length_stats(spark, d):
    return rounded(tokens.length_stats(_tokenized(spark, d)), "mean_length", "p50", "p90", "p95", "p99")


@query("sort_by_length", """
SELECT doc_id, CAST(length AS INTEGER) AS length, row_number() OVER (ORDER BY length, doc_id) - 1 AS length_rank FROM tokenized""",
       "tokenized")
def sort_by_length(spark, d):
    return tokens.sort_by_length(_tokenized(spark, d).select("doc_id", "length"), ["doc_id"])


view("vocab", r"""
  SELECT token, CASE WHEN count(DISTINCT script) > 1 THEN 'Mixed' ELSE min(script) END AS "group"
  FROM (SELECT unnest(regexp_extract_all(text, '\S+')) AS token,
               CASE lang WHEN 'en' THEN 'en_Latn' WHEN 'fr' THEN 'fr_Latn' WHEN 'de' THEN 'Cyrl' ELSE 'UNK' END AS script
        FROM documents)
  GROUP BY token
""")


def _vocabulary(spark, d):
    code = F.when(F.col("lang") == "de", "de_Cyrl").when(F.col("lang") == "es", "es").otherwise(
        F.concat("lang", F.lit("_Latn")))
    return tokens.vocabulary_by_script(
        spread(B.table(spark, d, "documents")).withColumn("lang", code), tokens.pattern_tokenizer())


@query("vocab_by_script", 'SELECT token, "group" FROM vocab', "vocab")
def vocab_by_script(spark, d):
    return _vocabulary(spark, d)


@query("token_embedding_lookup", """
SELECT token, "group", token_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total
FROM (SELECT *, ('0x' || md5('token|' || token)[1:15])::BIGINT % 600 AS token_id FROM vocab WHERE "group" <> 'Mixed')
JOIN embeddings ON vec_id = token_id""", "vocab")
def token_embedding_lookup(spark, d):
    vocabulary = _vocabulary(spark, d).withColumn("token_id", draw_int("token", "token") % 600)
    store = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("token_id"), "embedding")
    found = tokens.lookup_embeddings(vocabulary, store, skip_mixed=True)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rounded(found.select("token", "group", "token_id", total.alias("total")), "total")


@query("sample_k", """
SELECT doc_id, lang FROM documents ORDER BY md5('3|' || doc_id), doc_id LIMIT 150""")
def sample_k(spark, d):
    rows = B.table(spark, d, "documents").select("doc_id", "lang")
    return ranking.keep_drawn(rows, ["doc_id"], lambda n: F.least(n, F.lit(150)), seed=3)
