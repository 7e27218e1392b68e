"""Queries over result rows, language groups and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import langsets as L, quality as Q, tables as T
from . import bindings as B
from .registry import ORACLES, query, view

METHODS = ["A", "N", "R"]


def rounded(df, *columns, digits: int = 6):
    """The named columns rounded, so that the order of summation does not show."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


view("pooled", """
  SELECT method, seed, target_lang, sum(accuracy * n) / sum(n) AS acc, CAST(sum(n) AS BIGINT) AS n_items,
         CAST(greatest(count(DISTINCT fold), 1) AS INTEGER) AS n_folds
  FROM result_rows GROUP BY ALL
""")
view("by_seed", """
  SELECT method, target_lang, avg(acc) AS mean_acc, stddev_samp(acc) AS seed_std, count(*) AS n_seeds, max(n_items) AS n_items
  FROM pooled GROUP BY ALL
""")


@query("score_mcqa", """
SELECT target_lang, round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n
FROM predicted GROUP BY target_lang""", "item_scores predicted")
def score_mcqa(spark, d):
    scores = {x: f"score_{x.lower()}" for x in "ABCD"}
    return rounded(T.score_items(B.item_scores(spark, d), task="target_lang", gold="gold", scores=scores), "accuracy")


@query("confusion_matrix", """
SELECT gold, count(*) FILTER (pred = 'A') AS "pred_A", count(*) FILTER (pred = 'B') AS "pred_B",
       count(*) FILTER (pred = 'C') AS "pred_C", count(*) FILTER (pred = 'D') AS "pred_D"
FROM predicted GROUP BY gold""", "item_scores predicted")
def confusion_matrix(spark, d):
    scores = {x: f"score_{x.lower()}" for x in "ABCD"}
    items = B.item_scores(spark, d).withColumn("pred", T.predicted_letter(scores))
    return T.confusion_matrix(items, gold="gold", pred="pred", labels=list("ABCD"))


@query("drop_failed", """
SELECT method, seed, fold, target_lang, round(accuracy, 6) AS accuracy, n
FROM result_rows WHERE n % 7 <> 0""", "result_rows")
def drop_failed(spark, d):
    failed = B.result_rows(spark, d).withColumn("accuracy", F.when(F.col("n") % 7 != 0, F.col("accuracy")))
    return rounded(T.drop_failed(failed).drop("llm"), "accuracy")


@query("pool_folds", """
SELECT method, seed, target_lang, round(acc, 6) AS acc, n_items, n_folds FROM pooled""", "result_rows pooled")
def pool_folds(spark, d):
    return rounded(T.pool_folds(B.result_rows(spark, d)), "acc")


@query("seed_mean_std", """
SELECT method, target_lang, round(mean_acc, 6) AS mean_acc, round(seed_std, 6) AS seed_std, n_seeds, n_items FROM by_seed""",
       "result_rows pooled by_seed")
def seed_mean_std(spark, d):
    return rounded(T.seed_mean_std(T.pool_folds(B.result_rows(spark, d))), "mean_acc", "seed_std")


@query("pool_zero_shot", """
SELECT method, target_lang, round(mean_acc, 6) AS mean_acc, CAST(NULL AS DOUBLE) AS seed_std, CAST(0 AS BIGINT) AS n_seeds, n_items
FROM base""", "zero_shot_rows base")
def pool_zero_shot(spark, d):
    return rounded(T.pool_zero_shot(B.zero_shot_rows(spark, d)), "mean_acc")


@query("grid_with_zero_shot", """
SELECT method, target_lang, round(mean_acc, 6) AS mean_acc, round(seed_std, 6) AS seed_std, n_seeds, n_items FROM by_seed
UNION ALL
SELECT method, target_lang, round(mean_acc, 6), NULL, 0, n_items FROM base
WHERE target_lang IN (SELECT target_lang FROM by_seed)""", "result_rows pooled by_seed zero_shot_rows base")
def grid_with_zero_shot(spark, d):
    long = T.seed_mean_std(T.pool_folds(B.result_rows(spark, d)))
    return rounded(T.with_zero_shot(long, T.pool_zero_shot(B.zero_shot_rows(spark, d))), "mean_acc", "seed_std")


@query("perf_groups", "SELECT target_lang, rank, perf FROM perf", "zero_shot_rows base perf")
def perf_groups(spark, d):
    return T.performance_groups(T.pool_zero_shot(B.zero_shot_rows(spark, d)))


@query("perf_cut_ties", """
SELECT cut, round(mean_acc, 6) AS mean_acc, last_in, first_out
FROM (SELECT *, lead(mean_acc) OVER w AS next_acc, lead(target_lang) OVER w AS first_out, target_lang AS last_in,
             row_number() OVER w AS rk, count(*) OVER () AS n
      FROM (SELECT target_lang, round(mean_acc, 2) AS mean_acc FROM base)
      WINDOW w AS (ORDER BY mean_acc DESC, target_lang)),
     (SELECT unnest(['high', 'low']) AS cut)
WHERE rk = CASE cut WHEN 'high' THEN round_even(n * 0.5, 0) ELSE n - floor(n * 0.25) END
  AND rk < n AND mean_acc = next_acc""", "zero_shot_rows base")
def perf_cut_ties(spark, d):
    base = T.pool_zero_shot(B.zero_shot_rows(spark, d)).withColumn("mean_acc", F.round("mean_acc", 2))
    return rounded(T.performance_ties(base), "mean_acc")


LANG_TABLE_SQL = """
SELECT target_lang,
       CASE WHEN target_lang IN (SELECT lang FROM seen_langs) THEN 1
            WHEN target_lang IN (SELECT lang FROM low_langs) THEN -1 ELSE 0 END AS seen,
       perf, zero_shot_acc, "A_acc", "N_acc", "R_acc", "A_std", "N_std", "R_std", n_seeds, n_items
FROM (
  SELECT target_lang, round(max(mean_acc) FILTER (method = 'zero_shot'), 6) AS zero_shot_acc,
         round(max(mean_acc) FILTER (method = 'A'), 6) AS "A_acc", round(max(mean_acc) FILTER (method = 'N'), 6) AS "N_acc",
         round(max(mean_acc) FILTER (method = 'R'), 6) AS "R_acc", round(max(seed_std) FILTER (method = 'A'), 6) AS "A_std",
         round(max(seed_std) FILTER (method = 'N'), 6) AS "N_std", round(max(seed_std) FILTER (method = 'R'), 6) AS "R_std",
         max(n_seeds) AS n_seeds, max(n_items) AS n_items
  FROM (SELECT method, target_lang, mean_acc, seed_std, n_seeds, n_items FROM by_seed
        UNION ALL SELECT method, target_lang, mean_acc, NULL, 0, n_items FROM base
        WHERE target_lang IN (SELECT target_lang FROM by_seed))
  GROUP BY target_lang) JOIN perf USING (target_lang)"""


@query("lang_table", LANG_TABLE_SQL, "result_rows pooled by_seed zero_shot_rows base perf lang_groups seen_langs low_langs")
def lang_table(spark, d):
    wide = T.lang_table(
        B.result_rows(spark, d), seen=B.seen_langs(spark, d), low=B.low_langs(spark, d),
        zero_shot=B.zero_shot_rows(spark, d))
    return rounded(wide, *[c for c in wide.columns if c.endswith(("_acc", "_std"))])


@query("seen_flag", """
SELECT n_name AS target_lang, CASE WHEN n_name IN (SELECT lang FROM seen_langs) THEN 1
       WHEN n_name IN (SELECT lang FROM low_langs) THEN -1 ELSE 0 END AS seen, count(*) AS n_items
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""", "lang_groups seen_langs low_langs")
def seen_flag(spark, d):
    wide = B.table(spark, d, "customer").join(
        B.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_name").alias("target_lang")).agg(F.count(F.lit(1)).alias("n_items"))
    return T.add_seen(wide, B.seen_langs(spark, d), B.low_langs(spark, d))


@query("perf_flag", """
SELECT target_lang, CASE WHEN target_lang IN (SELECT lang FROM seen_langs) THEN 1
       WHEN target_lang IN (SELECT lang FROM low_langs) THEN -1 ELSE 0 END AS seen, perf, n_items
FROM base JOIN perf USING (target_lang)""", "zero_shot_rows base perf lang_groups seen_langs low_langs")
def perf_flag(spark, d):
    base = T.pool_zero_shot(B.zero_shot_rows(spark, d))
    wide = T.add_seen(base.select("target_lang", "n_items"), B.seen_langs(spark, d), B.low_langs(spark, d))
    return T.add_perf(wide, T.performance_groups(base))


@query("restrict_langs", """
SELECT method, seed, fold, target_lang, round(accuracy, 6) AS accuracy, n FROM result_rows
WHERE target_lang IN (SELECT lang FROM lang_groups WHERE "group" = 'core')""", "result_rows lang_groups")
def restrict_langs(spark, d):
    core = L.langs_of(B.lang_groups(spark, d), "core")
    return rounded(L.restrict_langs(B.result_rows(spark, d), core).drop("llm"), "accuracy")


@query("restrict_seeds", """
SELECT method, seed, fold, target_lang, round(accuracy, 6) AS accuracy, n FROM result_rows WHERE seed IN (2, 4, 6)""",
       "result_rows")
def restrict_seeds(spark, d):
    return rounded(T.restrict_seeds(B.result_rows(spark, d), [2, 4, 6]).drop("llm"), "accuracy")


@query("exclude_sources", """
SELECT source_group, target_lang, round("A_acc", 6) AS "A_acc" FROM source_tables
WHERE target_lang NOT IN (SELECT lang FROM lang_groups WHERE "group" = 'core')""",
       "zero_shot_rows base perf lang_groups seen_langs low_langs source_tables")
def exclude_sources(spark, d):
    core = L.langs_of(B.lang_groups(spark, d), "core")
    kept = L.exclude_langs(B.source_tables(spark, d), core)
    return rounded(kept.select("source_group", "target_lang", "A_acc"), "A_acc")


@query("known_languages", """
SELECT c_custkey, n_name AS lang FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 5 <> 0""")
def known_languages(spark, d):
    # Codes of every fifth language carry the archive suffix and drop out.
    nation = B.table(spark, d, "nation").withColumn(
        "code", F.when(F.col("n_nationkey") % 5 == 0, F.concat("n_name", F.lit(".zip"))).otherwise(F.col("n_name")))
    rows = B.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("code").alias("lang"))
    return L.known_languages(rows, B.dimension(spark, d)).select("c_custkey", "lang")


@query("group_set_algebra", """
SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'left_only' ELSE 'right_only' END AS part, lang
FROM (SELECT lang, bool_or("group" = 'core') AS a, bool_or("group" = 'west') AS b
      FROM lang_groups WHERE "group" IN ('core', 'west') GROUP BY lang)""", "lang_groups")
def group_set_algebra(spark, d):
    return L.group_algebra(B.lang_groups(spark, d), "core", "west")


view("members", """
  SELECT "group", lang FROM lang_groups UNION ALL SELECT "group", lang FROM lang_groups WHERE "group" = 'west'
""")


@query("group_invariants", """
SELECT 'duplicate' AS problem, "group", lang FROM members GROUP BY ALL HAVING count(*) > 1
UNION SELECT 'code', "group", lang FROM members WHERE NOT regexp_full_match(lang, '[A-Z]+')
UNION SELECT 'overlap', 'core&west', lang FROM members WHERE "group" IN ('core', 'west') GROUP BY lang HAVING count(DISTINCT "group") = 2""", "lang_groups members")
def group_invariants(spark, d):
    """One group listed twice, codes of one word only, and two groups that should not share a language."""
    groups = B.lang_groups(spark, d).select("group", "lang")
    return L.group_problems(groups.unionByName(groups.where("group = 'west'")), [("core", "west")], r"^[A-Z]+$")


@query("dimension_summary", """
SELECT axis, value, count(*) AS n_langs FROM (
  SELECT 'class' AS axis, CAST(class AS VARCHAR) AS value FROM dimension
  UNION ALL SELECT 'family', family FROM dimension UNION ALL SELECT 'region', region FROM dimension
  UNION ALL SELECT 'group', 'class5' FROM dimension WHERE class = 5
  UNION ALL SELECT 'group', 'seen' FROM dimension WHERE xlmr = 1
  UNION ALL SELECT 'group', 'low_perf' FROM dimension WHERE low_perf = 1)
GROUP BY ALL""", "dimension")
def dimension_summary(spark, d):
    return L.dimension_summary(B.dimension(spark, d))


view("last_runs", """
  SELECT method, seed, fold, lr, path, best_val_acc
  FROM (SELECT *, row_number() OVER (PARTITION BY method, lr, fold, seed ORDER BY path DESC) AS k FROM valid_rows) WHERE k = 1
""")
view("searched", """
  SELECT method, lr, fold, count(*) AS n_seeds, avg(best_val_acc) AS mean_val_acc, stddev_samp(best_val_acc) AS seed_std
  FROM last_runs GROUP BY ALL
""")


@query("dedup_reruns", """
SELECT method, seed, fold, lr, path, round(best_val_acc, 6) AS best_val_acc FROM last_runs""", "valid_rows last_runs")
def dedup_reruns(spark, d):
    kept = T.dedup_reruns(B.valid_rows(spark, d), ["method", "lr", "fold", "seed"], swept="lr")
    return rounded(kept, "best_val_acc")


@query("lr_search_table", """
SELECT method, lr, fold, n_seeds, round(mean_val_acc, 6) AS mean_val_acc, round(seed_std, 6) AS seed_std FROM searched""",
       "valid_rows last_runs searched")
def lr_search_table(spark, d):
    return rounded(T.search_table(B.valid_rows(spark, d), "lr"), "mean_val_acc", "seed_std")


@query("best_by_group", """
SELECT method, fold, lr, n_seeds, mean_val_acc, round(seed_std, 6) AS seed_std
FROM (SELECT *, row_number() OVER (PARTITION BY method, fold ORDER BY mean_val_acc DESC, lr) AS k
      FROM (SELECT method, fold, lr, n_seeds, round(mean_val_acc, 6) AS mean_val_acc, seed_std FROM searched)) WHERE k = 1""",
       "valid_rows last_runs searched")
def best_by_group(spark, d):
    found = rounded(T.search_table(B.valid_rows(spark, d), "lr"), "mean_val_acc")
    return rounded(T.best_by_group(found, "lr"), "seed_std")


@query("expand_target_groups", """
SELECT source_group, target_lang, g.target_group, g.target_rank
FROM source_tables, (SELECT unnest([{'target_group': 'low-perf', 'target_rank': 0}, {'target_group': 'unseen', 'target_rank': 1},
                    {'target_group': 'seen', 'target_rank': 2}, {'target_group': 'all', 'target_rank': 3}]) AS g)
WHERE CASE g.target_rank WHEN 0 THEN seen = -1 WHEN 1 THEN seen <= 0 WHEN 2 THEN seen = 1 ELSE true END""",
       "zero_shot_rows base perf lang_groups seen_langs low_langs source_tables")
def expand_target_groups(spark, d):
    return T.expand_target_groups(B.source_tables(spark, d), "seen").select(
        "source_group", "target_lang", "target_group", "target_rank")


def _target_source_sql(column: str, labels: list[str], tests: list[str]) -> str:
    groups = " UNION ALL ".join(
        f"SELECT '{label}' AS target_group, {i} AS target_rank, t.* FROM kept t WHERE {test}"
        for i, (label, test) in enumerate(zip(labels, tests)))
    measures = ["zero_shot_acc", "A_acc", "N_acc", "R_acc", "A_std", "N_std", "R_std"]
    averages = ", ".join(f'round(avg("{m}") * 100, 4) AS "{m}"' for m in measures)
    return f"""
, kept AS (SELECT * FROM source_tables WHERE target_lang NOT IN (SELECT lang FROM lang_groups WHERE "group" = 'core')),
member AS ({groups}),
whole AS (
  SELECT target_group, target_rank, source_group, grid, count(*) AS n_langs, min(n_seeds) AS n_seeds, {averages},
         count(DISTINCT target_lang) AS covered
  FROM member GROUP BY ALL),
cells AS (
  SELECT w.* FROM whole w JOIN (SELECT target_group, count(DISTINCT target_lang) AS c FROM member GROUP BY 1) r USING (target_group)
  WHERE w.covered = r.c)
SELECT cells.* EXCLUDE (covered), CAST(row_number() OVER (PARTITION BY target_group ORDER BY s.n, source_group) AS INTEGER) AS source_rank
FROM cells JOIN (SELECT "group" AS source_group, count(*) AS n FROM lang_groups GROUP BY 1) s USING (source_group)"""


SOURCE_VIEWS = "zero_shot_rows base perf lang_groups seen_langs low_langs source_tables"
MEASURES = ["zero_shot_acc", "A_acc", "N_acc", "R_acc", "A_std", "N_std", "R_std"]


def _target_source(spark, d, flavour):
    groups = B.lang_groups(spark, d)
    return rounded(T.target_source_table(
        B.source_tables(spark, d), flavour=flavour, exclude=L.langs_of(groups, "core"), excluded="core",
        sizes=L.source_sizes(groups)), *MEASURES, digits=4)


@query("target_source_table", _target_source_sql(
    "perf", ["low-perf", "all wo high-perf", "high-perf wo core", "all wo core"],
    ["perf = 'low'", "perf <> 'high'", "perf = 'high'", "true"]), SOURCE_VIEWS)
def target_source_table(spark, d):
    return _target_source(spark, d, "perf")


@query("target_source_table_seen", _target_source_sql(
    "seen", ["low-perf", "unseen", "seen", "all"], ["seen = -1", "seen <= 0", "seen = 1", "true"]), SOURCE_VIEWS)
def target_source_table_seen(spark, d):
    return _target_source(spark, d, "seen")


_RUN_COLUMNS = {f"run{m}{s}": (m, f) for m in METHODS for f, s in enumerate(("", "#2", "#3"))}


@query("align_runs", "SELECT target_lang, " + ", ".join(
    f"max(accuracy) FILTER (method = '{m}' AND fold = {f}) AS \"{name}\"" for name, (m, f) in _RUN_COLUMNS.items()) + """
FROM (SELECT method, fold, target_lang, round(sum(accuracy * n) / sum(n), 6) AS accuracy FROM result_rows GROUP BY ALL)
GROUP BY target_lang""", "result_rows")
def align_runs(spark, d):
    pooled = T.pool_folds(B.result_rows(spark, d).withColumn("seed", F.col("fold")))
    rows = pooled.select(
        F.concat(F.lit("run"), "method").alias("run_name"), F.concat(F.lit("2026010"), "seed", "method").alias("path"),
        "target_lang", F.round("acc", 6).alias("accuracy"))
    return T.align_runs(rows)


@query("result_table_by_run", ORACLES["align_runs"])
def result_table_by_run(spark, d):
    """Rows without seeds: the table that is found for them has one column per run."""
    pooled = T.pool_folds(B.result_rows(spark, d).withColumn("seed", F.col("fold")))
    rows = pooled.select(
        F.concat(F.lit("run"), "method").alias("run_name"), F.concat(F.lit("2026010"), "seed", "method").alias("path"),
        F.lit(None).cast("int").alias("seed"), "target_lang", F.round("acc", 6).alias("accuracy"))
    return T.result_table(rows, B.lang_groups(spark, d))


@query("result_table_by_seed", ORACLES["lang_table"])
def result_table_by_seed(spark, d):
    """Rows with seeds: one row per language, flags by the groups of their backbone."""
    rows = B.result_rows(spark, d).withColumn("llm", F.lit("g4")).withColumn("run_name", F.concat_ws("-", "method", "seed", "fold"))
    of = lambda df, name: df.select(F.lit(name).alias("group"), "lang")
    wide = T.result_table(rows, of(B.seen_langs(spark, d), "gemma_high"), low_groups=of(B.low_langs(spark, d), "g4"), zero_shot=B.zero_shot_rows(spark, d))
    return rounded(wide, *[c for c in wide.columns if c.endswith(("_acc", "_std"))])


@query("check_unique", """
SELECT method, seed, fold, target_lang, run_name, CAST(1 AS BIGINT) AS n_rows, CAST(2 AS BIGINT) AS n_total
FROM result_rows, (SELECT unnest(['first', 'second']) AS run_name) WHERE n % 5 = 0""", "result_rows")
def check_unique(spark, d):
    rows = B.result_rows(spark, d)
    runs = F.when(F.col("n") % 5 == 0, F.array(F.lit("first"), F.lit("second"))).otherwise(F.array(F.lit("first")))
    return Q.duplicate_results(rows.withColumn("run_name", F.explode(runs)))


view("thin", """
  SELECT method, lr, fold, count(*) AS n_seeds
  FROM (SELECT *, row_number() OVER (PARTITION BY method, lr, fold, seed ORDER BY path DESC) AS k
        FROM valid_rows WHERE NOT (seed = 7 AND best_val_acc < 0.5))
  WHERE k = 1 GROUP BY ALL
""")


@query("incomplete_seeds", """
SELECT method, lr, fold, n_seeds, (SELECT max(n_seeds) FROM thin) AS max_seeds FROM thin
WHERE n_seeds < (SELECT max(n_seeds) FROM thin)""", "valid_rows thin")
def incomplete_seeds(spark, d):
    # Runs of seed 7 with a low score count as crashed, so their cells lack a seed.
    rows = B.valid_rows(spark, d).where(~((F.col("seed") == 7) & (F.col("best_val_acc") < 0.5)))
    return Q.incomplete_seeds(T.search_table(rows, "lr"), ["method", "lr", "fold"])


@query("incomplete_items", """
SELECT target_lang, max(n_items) AS n_items, (SELECT max(n_items) FROM by_seed) AS max_items
FROM by_seed GROUP BY target_lang HAVING max(n_items) <> (SELECT max(n_items) FROM by_seed)""",
       "result_rows pooled by_seed")
def incomplete_items(spark, d):
    return Q.incomplete_items(T.seed_mean_std(T.pool_folds(B.result_rows(spark, d))))


@query("zero_shot_consistency", """
SELECT target_group, round(max(z) - min(z), 4) AS spread, count(*) AS n_sources, min(n) AS min_langs, max(n) AS max_langs
FROM (SELECT g AS target_group, source_group, avg(zero_shot_acc) * 100 AS z, count(*) AS n
      FROM source_tables, (SELECT unnest(['all', 'unseen']) AS g)
      WHERE g = 'all' OR seen <= 0 GROUP BY ALL)
GROUP BY target_group HAVING max(z) - min(z) > 1e-6""", SOURCE_VIEWS)
def zero_shot_consistency(spark, d):
    member = T.expand_target_groups(B.source_tables(spark, d), "seen").where(
        F.col("target_group").isin("all", "unseen"))
    cells = member.groupBy("target_group", "source_group").agg(
        (F.avg("zero_shot_acc") * 100).alias("zero_shot_acc"), F.count(F.lit(1)).alias("n_langs"))
    return rounded(Q.baseline_spread(cells), "spread", digits=4)


@query("single_backbone", """
SELECT llm, count(*) AS n_rows, (SELECT count(DISTINCT event_type) FROM events) = 1 AS ok
FROM (SELECT event_type AS llm FROM events) GROUP BY llm""")
def single_backbone(spark, d):
    return Q.backbones(B.table(spark, d, "events").select(F.col("event_type").alias("llm")))


@query("split_size_check", """
SELECT lang, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'validation') AS n_validation,
       count(*) FILTER (split = 'test') AS n_test, CAST(0 AS BIGINT) AS n_other,
       n_train = 701 AND n_validation = 99 AND n_test = 204 AS ok
FROM topic_src GROUP BY lang""", "topic_src")
def split_size_check(spark, d):
    from ..constants import TOPIC_SPLIT_SIZES
    return Q.split_sizes(B.topic_src(spark, d), TOPIC_SPLIT_SIZES)
