"""The given tables bound to the logical schemas the operators read.

Each DataFrame function has a SQL view of the same name beside it for the oracle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.draws import draw_int
from ..functions.names import embedding_key
from ..session import settle
from .registry import view


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# ---- results

def _language_of_suppliers(spark, sf_dir) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("target_lang"))


def _cells(spark, sf_dir, keys: dict, hit) -> DataFrame:
    """Hits and items per (keys, language): summed per supplier before the join."""
    per_supplier = table(spark, sf_dir, "lineitem").groupBy(
        *[c.alias(k) for k, c in keys.items()], "l_suppkey").agg(
        F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("items"))
    return per_supplier.join(_language_of_suppliers(spark, sf_dir), "l_suppkey").groupBy(
        *keys, "target_lang").agg(F.sum("hits").alias("hits"), F.sum("items").alias("items"))


def _grid_keys() -> dict:
    return {"method": F.col("l_returnflag"), "seed": F.col("l_linenumber"),
            "fold": (F.col("l_orderkey") % 3).cast("int")}


def result_rows(spark, sf_dir) -> DataFrame:
    cells = _cells(spark, sf_dir, _grid_keys(), F.col("l_linestatus") == "F")
    return cells.select("method", "seed", "fold", "target_lang",
                        (F.col("hits") / F.col("items")).alias("accuracy"), F.col("items").alias("n"),
                        F.lit("base").alias("llm"))


view("result_rows", """
  SELECT l_returnflag AS method, l_linenumber AS seed, CAST(l_orderkey % 3 AS INTEGER) AS fold,
         n_name AS target_lang,
         CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) / count(*) AS accuracy,
         count(*) AS n, 'base' AS llm
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY ALL
""")


def zero_shot_rows(spark, sf_dir) -> DataFrame:
    per_customer = table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 3).cast("int").alias("fold")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("hits"), F.count(F.lit(1)).alias("items"))
    customers = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return per_customer.join(customers, "c_custkey").groupBy("fold", F.col("n_name").alias("target_lang")).agg(
        (F.sum("hits") / F.sum("items")).alias("accuracy"), F.sum("items").alias("n"))


view("zero_shot_rows", """
  SELECT CAST(o_orderkey % 3 AS INTEGER) AS fold, n_name AS target_lang,
         CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) AS accuracy, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL
""")


def valid_rows(spark, sf_dir) -> DataFrame:
    """Validation rows of a sweep over `lr`, with a later rerun of seeds 1 and 2."""
    lr = F.floor(F.col("l_quantity") / 10) / 10.0
    cells = table(spark, sf_dir, "lineitem").groupBy(
        *[c.alias(k) for k, c in _grid_keys().items()], lr.alias("lr")).agg(
        F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count_if(F.col("l_linestatus") == "O").alias("o"),
        F.count(F.lit(1)).alias("items"))
    first = F.struct(F.lit("20260101_run").alias("path"), (F.col("f") / F.col("items")).alias("best_val_acc"))
    rerun = F.struct(F.lit("20260202_rerun").alias("path"), (F.col("o") / F.col("items")).alias("best_val_acc"))
    runs = F.when(F.col("seed") <= 2, F.array(first, rerun)).otherwise(F.array(first))
    return cells.select("method", "seed", "fold", "lr", F.explode(runs).alias("r")).select(
        "method", "seed", "fold", "lr", "r.*")


view("valid_rows", """
  SELECT l_returnflag AS method, l_linenumber AS seed, CAST(l_orderkey % 3 AS INTEGER) AS fold,
         floor(l_quantity / 10) / 10.0 AS lr, '20260101_run' AS path,
         CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) / count(*) AS best_val_acc
  FROM lineitem GROUP BY ALL
  UNION ALL
  SELECT l_returnflag, l_linenumber, CAST(l_orderkey % 3 AS INTEGER), floor(l_quantity / 10) / 10.0, '20260202_rerun',
         CAST(count(*) FILTER (l_linestatus = 'O') AS DOUBLE) / count(*)
  FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL
""")


# ---- language groups

def lang_groups(spark, sf_dir) -> DataFrame:
    """Region groups, the overlapping group `core` (first language of each region)
    and `west` (two regions)."""
    n = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    firsts = n.groupBy("r_regionkey").agg(F.min("n_nationkey").alias("n_nationkey")).select("n_nationkey")
    parts = [
        n.select(F.col("r_name").alias("group"), F.col("n_name").alias("lang"), F.col("n_nationkey").alias("ord")),
        n.join(firsts, "n_nationkey", "left_semi").select(
            F.lit("core").alias("group"), F.col("n_name").alias("lang"), F.col("n_nationkey").alias("ord")),
        n.where(F.col("r_name").isin("AMERICA", "EUROPE")).select(
            F.lit("west").alias("group"), F.col("n_name").alias("lang"), F.col("n_nationkey").alias("ord")),
    ]
    return reduce(DataFrame.unionByName, parts)


view("lang_groups", """
  SELECT r_name AS "group", n_name AS lang, n_nationkey AS ord FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 'core', n_name, n_nationkey FROM nation
  WHERE n_nationkey IN (SELECT min(n_nationkey) FROM nation GROUP BY n_regionkey)
  UNION ALL
  SELECT 'west', n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE r_name IN ('AMERICA', 'EUROPE')
""")


def seen_langs(spark, sf_dir) -> DataFrame:
    return lang_groups(spark, sf_dir).where("`group` = 'west'").select("lang").distinct()


def low_langs(spark, sf_dir) -> DataFrame:
    return lang_groups(spark, sf_dir).where("`group` = 'AFRICA'").select("lang").distinct()


view("seen_langs", """SELECT DISTINCT lang FROM lang_groups WHERE "group" = 'west'""")
view("low_langs", """SELECT DISTINCT lang FROM lang_groups WHERE "group" = 'AFRICA'""")


def dimension(spark, sf_dir) -> DataFrame:
    """A language dimension: class and flags come from keys of the nation table."""
    n = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    return n.select(
        F.col("n_name").alias("code"), (k % 6).alias("class"), F.substring("n_name", 1, 1).alias("family"),
        F.col("r_name").alias("region"), (k % 2).alias("xlmr"),
        F.when((k % 2 == 0) & (k % 3 == 0), 1).otherwise(0).alias("low_perf"))


view("dimension", """
  SELECT n_name AS code, n_nationkey % 6 AS class, n_name[1:1] AS family, r_name AS region,
         n_nationkey % 2 AS xlmr, CASE WHEN n_nationkey % 6 = 0 THEN 1 ELSE 0 END AS low_perf
  FROM nation JOIN region ON n_regionkey = r_regionkey
""")


def source_tables(spark, sf_dir) -> DataFrame:
    """Language tables of five source groups (regions), without their own languages."""
    from ..operators.tables import pool_zero_shot, with_performance

    region = table(spark, sf_dir, "region")
    keys = {"source_key": (F.col("l_partkey") % 5).cast("int"), "method": F.col("l_returnflag"),
            "seed": F.col("l_linenumber")}
    cells = _cells(spark, sf_dir, keys, F.col("l_linestatus") == "F").join(
        region, F.col("source_key") == F.col("r_regionkey")).withColumnRenamed("r_name", "source_group")
    own = lang_groups(spark, sf_dir).select(F.col("group").alias("source_group"), F.col("lang").alias("target_lang"))
    long = cells.join(own, ["source_group", "target_lang"], "left_anti").withColumn(
        "acc", F.col("hits") / F.col("items")).groupBy("source_group", "target_lang", "method").agg(
        F.avg("acc").alias("mean"), F.stddev_samp("acc").alias("std"), F.count(F.lit(1)).alias("k"))
    base = with_performance(pool_zero_shot(zero_shot_rows(spark, sf_dir))).select(
        "target_lang", "perf", F.col("mean_acc").alias("zero_shot_acc"))

    def of(method, column):
        return F.max(F.when(F.col("method") == method, F.col(column)))

    wide = long.groupBy("source_group", "target_lang").agg(
        of("A", "mean").alias("A_acc"), of("N", "mean").alias("N_acc"), of("R", "mean").alias("R_acc"),
        of("A", "std").alias("A_std"), of("N", "std").alias("N_std"), of("R", "std").alias("R_std"),
        F.max("k").alias("n_seeds"))
    seen = seen_langs(spark, sf_dir).select(F.col("lang").alias("target_lang"), F.lit(1).alias("seen")).unionByName(
        low_langs(spark, sf_dir).select(F.col("lang").alias("target_lang"), F.lit(-1).alias("seen")))
    wide = wide.join(seen, "target_lang", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    # Language tables are stored results, one per source group.
    return settle(wide.join(base, "target_lang").withColumn("grid", F.lit("grid1")))


view("base", """
  SELECT 'zero_shot' AS method, target_lang, sum(accuracy * n) / sum(n) AS mean_acc, CAST(sum(n) AS BIGINT) AS n_items
  FROM zero_shot_rows GROUP BY target_lang
""")
view("perf", """
  SELECT target_lang, rank,
         CASE WHEN rank <= round_even(n * 0.5, 0) THEN 'high' WHEN rank > n - floor(n * 0.25) THEN 'low' ELSE 'mid' END AS perf
  FROM (SELECT target_lang, CAST(row_number() OVER (ORDER BY mean_acc DESC, target_lang) AS INTEGER) AS rank,
               count(*) OVER () AS n FROM base)
""")
view("source_tables", """
  SELECT w.*, CASE WHEN w.target_lang IN (SELECT lang FROM seen_langs) THEN 1
                   WHEN w.target_lang IN (SELECT lang FROM low_langs) THEN -1 ELSE 0 END AS seen,
         perf.perf, base.mean_acc AS zero_shot_acc, 'grid1' AS grid
  FROM (
    SELECT source_group, target_lang, max(mean) FILTER (method = 'A') AS A_acc, max(mean) FILTER (method = 'N') AS N_acc,
           max(mean) FILTER (method = 'R') AS R_acc, max(std) FILTER (method = 'A') AS A_std,
           max(std) FILTER (method = 'N') AS N_std, max(std) FILTER (method = 'R') AS R_std, max(k) AS n_seeds
    FROM (
      SELECT source_group, target_lang, method, avg(acc) AS mean, stddev_samp(acc) AS std, count(*) AS k
      FROM (
        SELECT r_name AS source_group, n_name AS target_lang, l_returnflag AS method, l_linenumber AS seed,
               CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) / count(*) AS acc
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
             JOIN region ON r_regionkey = l_partkey % 5
        WHERE n_regionkey <> r_regionkey
        GROUP BY ALL)
      GROUP BY ALL)
    GROUP BY ALL) w
  JOIN perf USING (target_lang) JOIN base USING (target_lang)
""")


# ---- items

def mcqa_src(spark, sf_dir) -> DataFrame:
    """One multiple-choice record per document, in the document's language."""
    words = F.split("text", " ")
    picked = [F.coalesce(F.try_element_at(words, F.lit(i)), F.lit("")).alias(f"mc_answer{i}") for i in range(1, 5)]
    pad = F.lit("  ")
    return table(spark, sf_dir, "documents").select(
        "lang", F.col("doc_id").alias("item"),
        F.floor(F.col("doc_id") / 10).cast("string").alias("link"),
        (F.col("doc_id") % 10).cast("int").alias("question_number"),
        F.col("text").alias("flores_passage"), F.concat(pad, F.col("source"), pad).alias("question"),
        *picked, (F.col("doc_id") % 4 + 1).cast("string").alias("correct_answer_num"))


view("mcqa_src", """
  SELECT lang, doc_id AS item, CAST(doc_id // 10 AS VARCHAR) AS link, CAST(doc_id % 10 AS INTEGER) AS question_number,
         text AS flores_passage, source AS stripped_question,
         coalesce(string_split(text, ' ')[1], '') AS mc_answer1, coalesce(string_split(text, ' ')[2], '') AS mc_answer2,
         coalesce(string_split(text, ' ')[3], '') AS mc_answer3, coalesce(string_split(text, ' ')[4], '') AS mc_answer4,
         doc_id % 4 + 1 AS correct
  FROM documents
""")


def cloze_src(spark, sf_dir) -> DataFrame:
    """Stories from documents: the whole text in six parts, two of them endings."""
    words, n = F.split("text", " "), F.size(F.split("text", " "))

    def part(i: int):
        lo, hi = F.floor(F.lit(i) * n / 6).cast("int"), F.floor(F.lit(i + 1) * n / 6).cast("int")
        return F.array_join(F.slice(words, lo + 1, hi - lo), " ")

    return table(spark, sf_dir, "documents").select(
        "lang", F.col("doc_id").alias("item"),
        *[part(i).alias(f"input_sentence_{i + 1}") for i in range(4)],
        part(4).alias("sentence_quiz1"), part(5).alias("sentence_quiz2"),
        (F.col("doc_id") % 2 + 1).cast("int").alias("answer_right_ending"))


view("cloze_src", """
  SELECT lang, doc_id AS item, doc_id % 2 + 1 AS ending,
         array_to_string(w[0 * n // 6 + 1 : 1 * n // 6], ' ') AS s1, array_to_string(w[1 * n // 6 + 1 : 2 * n // 6], ' ') AS s2,
         array_to_string(w[2 * n // 6 + 1 : 3 * n // 6], ' ') AS s3, array_to_string(w[3 * n // 6 + 1 : 4 * n // 6], ' ') AS s4,
         array_to_string(w[4 * n // 6 + 1 : 5 * n // 6], ' ') AS q1, array_to_string(w[5 * n // 6 + 1 : 6 * n // 6], ' ') AS q2
  FROM (SELECT *, string_split(text, ' ') AS w, len(string_split(text, ' ')) AS n FROM documents)
""")


def parallel_items(spark, sf_dir) -> DataFrame:
    """Item keys of every document in four languages."""
    return table(spark, sf_dir, "documents").select(
        F.explode(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])).alias("lang"),
        F.floor(F.col("doc_id") / 10).cast("string").alias("link"),
        (F.col("doc_id") % 10).cast("int").alias("question_number"))


view("parallel_items", """
  SELECT l.lang, CAST(doc_id // 10 AS VARCHAR) AS link, CAST(doc_id % 10 AS INTEGER) AS question_number
  FROM documents, (SELECT unnest(['de', 'en', 'es', 'fr']) AS lang) l
""")


def topic_src(spark, sf_dir) -> DataFrame:
    """Topic records: category by document number, splits by number as well."""
    from ..constants import TOPIC_LABELS

    names = F.array(*[F.lit(x) for x in TOPIC_LABELS])
    place = F.col("doc_id") % 10
    return table(spark, sf_dir, "documents").select(
        "lang", F.when(place < 7, "train").when(place == 7, "validation").otherwise("test").alias("split"),
        F.col("doc_id").alias("index_id"),
        F.element_at(names, (F.col("doc_id") % 7 + 1).cast("int")).alias("category"), "text")


view("topic_src", """
  SELECT lang, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'validation' ELSE 'test' END AS split,
         doc_id AS index_id,
         ['science/technology', 'travel', 'politics', 'sports', 'health', 'entertainment', 'geography'][doc_id % 7 + 1] AS category,
         text
  FROM documents
""")


def item_scores(spark, sf_dir) -> DataFrame:
    """Answer-letter scores per document, drawn by digest."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item"), F.col("lang").alias("target_lang"),
        F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.col("doc_id") % 4 + 1).cast("int")).alias("gold"),
        *[(draw_int("score", "doc_id", F.lit(x)) % 16).alias(f"score_{x.lower()}") for x in "ABCD"])


view("item_scores", """
  SELECT doc_id AS item, lang AS target_lang, ['A', 'B', 'C', 'D'][doc_id % 4 + 1] AS gold,
         ('0x' || md5('score|' || doc_id || '|A')[1:15])::BIGINT % 16 AS score_a,
         ('0x' || md5('score|' || doc_id || '|B')[1:15])::BIGINT % 16 AS score_b,
         ('0x' || md5('score|' || doc_id || '|C')[1:15])::BIGINT % 16 AS score_c,
         ('0x' || md5('score|' || doc_id || '|D')[1:15])::BIGINT % 16 AS score_d
  FROM documents
""")
view("predicted", """
  SELECT *, CASE greatest(score_a, score_b, score_c, score_d)
              WHEN score_a THEN 'A' WHEN score_b THEN 'B' WHEN score_c THEN 'C' ELSE 'D' END AS pred
  FROM item_scores
""")


# ---- embeddings

def emb(spark, sf_dir) -> DataFrame:
    """Vectors with store keys: two methods, two layers, one language per label."""
    script = F.element_at(F.array(*[F.lit(s) for s in ("Latn", "Cyrl", "Arab")]), F.col("label") % 3 + 1)
    lang = F.concat(F.lit("l"), F.col("label"), F.lit("_"), script)
    method = F.when(F.col("vec_id") % 2 == 0, "xpe").otherwise("spt")
    layer = (F.floor(F.col("vec_id") / 2) % 2).cast("int")
    repo = F.concat(F.lit("lab/enc-Peft-"), method, F.lit("-x"))
    group = F.when(F.col("label") < 5, "seen").otherwise("low-perf")
    return table(spark, sf_dir, "embeddings").select(
        embedding_key(repo, group, lang, layer.cast("string")).alias("key"), method.alias("method"),
        lang.alias("lang"), layer.alias("layer"), "vec_id", "label",
        F.col("embedding").cast("array<double>").alias("embedding"))


view("emb", """
  SELECT 'lab/enc-Peft-' || method || '-x@' || grp || '@' || lang || '@' || layer AS key, method, lang, layer, vec_id, label, embedding
  FROM (SELECT CASE WHEN vec_id % 2 = 0 THEN 'xpe' ELSE 'spt' END AS method,
               CASE WHEN label < 5 THEN 'seen' ELSE 'low-perf' END AS grp,
               'l' || label || '_' || ['Latn', 'Cyrl', 'Arab'][label % 3 + 1] AS lang,
               CAST((vec_id // 2) % 2 AS INTEGER) AS layer, vec_id, label, embedding::DOUBLE[] AS embedding
        FROM embeddings)
""")
