"""Queries over run configurations, entries and the streaming rollup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CONFIG_SECTIONS
from ..operators import configs as C, quality as Q
from ..session import scratch_path, settle, spread
from ..streaming import rollup as S
from . import bindings as B
from .registry import query, view
from .result_queries import rounded


def _documents(spark, d):
    """One nested configuration per event; the first event of a user is its unit."""
    k, e, t = F.get_json_object("props", "$.k").cast("int"), F.col("event_id"), F.col("event_type")
    doc = C.encode({
        "mode": F.upper(t),
        "ds": F.struct((e % 2 == 0).alias("comes_with_splits"), F.lit("a/b").alias("path"), t.alias("category")),
        "training_args": F.struct(F.struct(
            (k % 5).alias("warmup_ratio"), (e % 3 == 0).alias("group_by_length"), e.alias("seed"),
            F.concat(F.lit("eps="), k % 3, F.lit(", fused=True, foreach=None")).alias("optim_args"),
            F.when(e % 4 == 0, 0.0).alias("label_smoothing_factor")).alias("args")),
        "peft": F.struct(
            F.when(e % 2 == 0, k % 3).alias("encoder_ratio"),
            F.when(e % 2 == 1, (k % 3).cast("string")).alias("encoder_text"),
            F.struct(F.struct((k % 2).alias("x")).alias("deep")).alias("nested")),
        "extra": F.struct(F.lit(1).alias("dropped")),
    })
    # The ratio is a number in even documents and text in odd ones, under one key.
    doc = F.replace(doc, F.lit("encoder_text"), F.lit("encoder_ratio"))
    return spread(B.table(spark, d, "events")).select(F.col("event_id").alias("run"), "user_id", doc.alias("doc"))


def _view(docs, ids):
    return C.config_view(C.flatten_documents(docs, ids=ids, sections=CONFIG_SECTIONS), ids=ids)


view("ev", """
  SELECT event_id AS run, user_id, event_type AS t, CAST(props ->> '$.k' AS INTEGER) AS k FROM events
""")
view("kv", """
  SELECT run, user_id, 'mode' AS key, '"' || lower(t) || '"' AS value FROM ev
  UNION ALL SELECT run, user_id, 'ds.splits', CASE WHEN run % 2 = 0 THEN 'true' ELSE 'false' END FROM ev
  UNION ALL SELECT run, user_id, 'ds.category', '"' || t || '"' FROM ev
  UNION ALL SELECT run, user_id, 'training_args.args.warmup_steps', CAST(k % 5 AS VARCHAR) FROM ev
  UNION ALL SELECT run, user_id, 'training_args.args.train_sampling_strategy', CASE WHEN run % 3 = 0 THEN '"group_by_length"' ELSE 'null' END FROM ev
  UNION ALL SELECT run, user_id, 'training_args.args.optim_args.eps', (k % 3) || '.0' FROM ev
  UNION ALL SELECT run, user_id, 'training_args.args.optim_args.fused', 'true' FROM ev
  UNION ALL SELECT run, user_id, 'training_args.args.optim_args.foreach', 'null' FROM ev
  UNION ALL SELECT run, user_id, 'training_args.args.label_smoothing_factor', '0.0' FROM ev WHERE run % 4 = 0
  UNION ALL SELECT run, user_id, 'peft.encoder_ratio', CASE WHEN run % 2 = 0 THEN CAST(k % 3 AS VARCHAR) ELSE '"' || (k % 3) || '"' END FROM ev
  UNION ALL SELECT run, user_id, 'peft.nested.deep.x', CAST(k % 2 AS VARCHAR) FROM ev
""")
view("unit_of", "SELECT user_id, min(run) AS unit FROM ev GROUP BY user_id")
view("pairs", """
  SELECT r.run, r.t, r.k, u.run AS unit, u.t AS ut, u.k AS uk
  FROM ev r JOIN unit_of USING (user_id) JOIN ev u ON u.run = unit_of.unit
""")
view("drift", """
  SELECT run, 'mode' AS key, '"' || lower(t) || '"' AS ran FROM pairs WHERE t <> ut
  UNION ALL SELECT run, 'ds.splits', CASE WHEN run % 2 = 0 THEN 'true' ELSE 'false' END FROM pairs WHERE run % 2 <> unit % 2
  UNION ALL SELECT run, 'ds.category', '"' || t || '"' FROM pairs WHERE t <> ut
  UNION ALL SELECT run, 'training_args.args.warmup_steps', CAST(k % 5 AS VARCHAR) FROM pairs WHERE k % 5 <> uk % 5
  UNION ALL SELECT run, 'training_args.args.train_sampling_strategy', CASE WHEN run % 3 = 0 THEN '"group_by_length"' ELSE 'null' END
            FROM pairs WHERE (run % 3 = 0) <> (unit % 3 = 0)
  UNION ALL SELECT run, 'training_args.args.optim_args.eps', (k % 3) || '.0' FROM pairs WHERE k % 3 <> uk % 3
  UNION ALL SELECT run, 'peft.encoder_ratio', CASE WHEN run % 2 = 0 THEN CAST(k % 3 AS VARCHAR) ELSE '"' || (k % 3) || '"' END
            FROM pairs WHERE k % 3 <> uk % 3
  UNION ALL SELECT run, 'peft.nested.deep.x', CAST(k % 2 AS VARCHAR) FROM pairs WHERE k % 2 <> uk % 2
""")


@query("flatten_config", "SELECT run, user_id, key, value FROM kv", "ev kv")
def flatten_config(spark, d):
    return _view(_documents(spark, d), ["run", "user_id"])


def _ran_and_unit(spark, d):
    docs = _documents(spark, d)
    events = B.table(spark, d, "events").select(F.col("event_id").alias("run"), "user_id")
    units = events.groupBy("user_id").agg(F.min("run").alias("run")).select("run")
    # The unit of a user is opened once and then repeated for each of its runs.
    unit_rows = _view(docs.join(units, "run", "left_semi"), ["user_id"])
    return _view(docs, ["run"]), events.join(unit_rows, "user_id").select("run", "key", "value")


@query("config_diff", "SELECT run, key, ran FROM drift", "ev unit_of pairs drift")
def config_diff(spark, d):
    return C.config_diff(*_ran_and_unit(spark, d))


@query("config_variants", """
SELECT method, row_number() OVER (PARTITION BY method ORDER BY first_run) AS variant, first_run, n_runs, folds,
       row_number() OVER (PARTITION BY method ORDER BY n_runs DESC, first_run) = 1 AS most_common
FROM (SELECT method, sig, min(run) AS first_run, count(*) AS n_runs,
             array_to_string(list_sort(list(DISTINCT CAST(run % 3 AS VARCHAR))), ',') AS folds
      FROM (SELECT ev.run, ev.t AS method, coalesce(string_agg(key || '=' || ran, ';' ORDER BY key), '') AS sig
            FROM ev LEFT JOIN drift USING (run) GROUP BY ev.run, ev.t)
      GROUP BY method, sig)""", "ev unit_of pairs drift")
def config_variants(spark, d):
    runs = B.table(spark, d, "events").select(
        F.col("event_id").alias("run"), F.col("event_type").alias("method"),
        (F.col("event_id") % 3).cast("string").alias("fold"))
    return C.config_variants(runs, C.config_diff(*_ran_and_unit(spark, d)))


@query("config_selfcheck", """
SELECT run, 'peft.encoder_ratio' AS key, CASE WHEN run % 2 = 0 THEN CAST(k % 3 AS VARCHAR) ELSE '"' || (k % 3) || '"' END AS ran
FROM ev WHERE run % 5 = 0 AND k % 3 <> 1""", "ev")
def config_selfcheck(spark, d):
    # Entries of every fifth run override one key; where the run did not follow, it shows.
    ran, unit = (settle(rows) for rows in _ran_and_unit(spark, d))
    entries = B.table(spark, d, "events").where(F.col("event_id") % 5 == 0).select(
        F.col("event_id").alias("run"), F.create_map(F.lit("peft.encoder_ratio"), F.lit("1")).alias("overrides"))
    return C.config_selfcheck(ran, unit, C.overrides_rows(entries), C.config_diff(ran, unit))


def _runs(spark, d):
    """Runs of a grid: cells whose item count is a multiple of 6 did not run, and
    some ran under two recipes."""
    cells = B.table(spark, d, "lineitem").groupBy(
        F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("seed"),
        (F.col("l_orderkey") % 3).cast("int").alias("fold"), (F.col("l_partkey") % 5).cast("int").alias("source")).agg(
        F.count(F.lit(1)).alias("n"))
    recipes = F.when(F.col("n") % 4 == 1, F.array(F.lit("v1"), F.lit("v2"))).otherwise(F.array(F.lit("v1")))
    return cells.where(F.col("n") % 6 != 0).withColumn("recipe", F.explode(recipes)).drop("n")


view("grid_cells", """
  SELECT l_returnflag AS method, l_linenumber AS seed, CAST(l_orderkey % 3 AS INTEGER) AS fold, CAST(l_partkey % 5 AS INTEGER) AS source, count(*) AS n
  FROM lineitem GROUP BY ALL
""")


@query("grid_coverage", """
SELECT method, seed, fold, source, status, CAST(n_runs AS BIGINT) AS n_runs, CASE WHEN status = 'missing' THEN 'v1' END AS usual_recipe
FROM (
  SELECT c.method, c.seed, c.fold, c.source,
         CASE WHEN n % 6 = 0 AND (c.method <> 'R' OR c.fold = 1) THEN 'missing'
              WHEN n % 6 <> 0 AND c.method = 'R' AND c.fold <> 1 THEN 'extra'
              WHEN n % 6 <> 0 AND n % 4 = 1 THEN 'several_recipes' END AS status,
         CASE WHEN n % 6 = 0 THEN 0 WHEN n % 4 = 1 THEN 2 ELSE 1 END AS n_runs
  FROM grid_cells c)
WHERE status IS NOT NULL""", "grid_cells")
def grid_coverage(spark, d):
    runs = settle(_runs(spark, d))
    # Method R was planned on fold 1 only.
    matrix = C.axes_product(runs, ["method", "seed"]).withColumn("pinned_fold", F.when(F.col("method") == "R", 1))
    expected = C.expand_matrix(matrix, C.axes_product(runs, ["source", "fold"]))
    return C.grid_coverage(expected, runs, cell=["method", "seed", "fold", "source"])


@query("join_runs_to_tracking", """
SELECT doc_id AS uuid4, source, turn, role, CASE WHEN turn IS NULL THEN 'no tracking record' END AS problem
FROM documents LEFT JOIN (SELECT conv_id, min(turn) AS turn, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id) ON conv_id = doc_id""")
def join_runs_to_tracking(spark, d):
    runs = B.table(spark, d, "documents").select(F.col("doc_id").alias("uuid4"), "source")
    log = B.table(spark, d, "conversations").select(F.col("conv_id").alias("uuid4"), "turn", "role")
    return C.join_tracking(runs, log, order=["turn"])


@query("validate_entries", """
SELECT name, rule FROM (
  SELECT name, unnest([
    CASE WHEN grp = 'bogus' THEN 'unknown_source_group' END,
    CASE WHEN grp IS NULL AND shapes > 0 THEN 'missing_source_group' END,
    CASE WHEN fold IS NOT NULL AND name % 5 = 0 THEN 'fold_on_unfolded_path' END,
    CASE WHEN shapes > 1 THEN 'exclusive_shapes' END,
    CASE WHEN (sep OR tun) <> (name % 3 = 0) THEN 'mode_mismatch' END]) AS rule
  FROM (SELECT o_orderkey AS name, CASE o_orderkey % 4 WHEN 0 THEN 'bogus' WHEN 1 THEN 'core' WHEN 2 THEN 'ASIA' END AS grp,
               CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 END AS fold,
               o_orderkey % 3 = 0 AS sep, o_orderkey % 10 = 0 AS tun, o_orderkey % 11 = 0 AS ada,
               (o_orderkey % 3 = 0)::INT + (o_orderkey % 10 = 0)::INT + (o_orderkey % 11 = 0)::INT AS shapes
        FROM orders))
WHERE rule IS NOT NULL""")
def validate_entries(spark, d):
    k = F.col("o_orderkey")
    entries = B.table(spark, d, "orders").select(
        k.alias("name"), F.when(k % 4 == 0, "bogus").when(k % 4 == 1, "core").when(k % 4 == 2, "ASIA").alias("source_group"),
        F.when(k % 7 > 0, k % 7).alias("fold"),
        F.when(k % 5 == 0, "m/b/en/tokenized").otherwise("m/b/en/fold0/tokenized").alias("dirs"),
        F.when(k % 3 == 0, "finetune").otherwise("test").alias("mode"),
        (k % 3 == 0).alias("separate_test"), (k % 10 == 0).alias("tune_only"), F.when(k % 11 == 0, "uuid").alias("adapter"))
    return Q.entry_violations(entries, B.lang_groups(spark, d))


@query("streaming_result_rollup", """
SELECT method, seed, target_lang, round(sum(accuracy * n) / sum(n), 6) AS acc, CAST(sum(n) AS BIGINT) AS n_items,
       CAST(count(DISTINCT fold) AS INTEGER) AS n_folds
FROM (SELECT method, seed, fold, target_lang, n, CASE WHEN seed <= 3 THEN accuracy / 2 ELSE accuracy END AS accuracy FROM result_rows)
GROUP BY ALL""", "result_rows")
def streaming_result_rollup(spark, d):
    # Every run lands once; runs of seeds 1 to 3 land again with halved accuracy.
    root = scratch_path(spark, "rollup")
    rows = B.result_rows(spark, d).withColumn("time_id", F.lit("20260101_000000"))
    rerun = rows.where(F.col("seed") <= 3).withColumns({
        "accuracy": F.col("accuracy") / 2, "time_id": F.lit("20260202_000000")})
    landed = rows.unionByName(rerun)
    landed.repartition(4).write.parquet(f"{root}/landing")
    stream = S.watch_results(spark, f"{root}/landing", landed.schema, files_per_batch=2)
    S.start_rollup(stream, f"{root}/changes", f"{root}/checkpoint").awaitTermination()
    return rounded(S.rollup(spark, f"{root}/changes"), "acc")
