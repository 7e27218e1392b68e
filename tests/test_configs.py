import json

from pyspark.sql import functions as F

from glossagrid.operators import configs as C
from glossagrid.streaming import rollup as S


def view_of(spark, doc, depth=6):
    docs = spark.createDataFrame([(1, json.dumps(doc))], "run int, doc string")
    return {r["key"]: r["value"] for r in C.config_view(C.flatten_documents(docs, ids=["run"], depth=depth), ids=["run"]).collect()}


def test_documents_flatten_into_todays_terms(spark):
    got = view_of(spark, {
        "mode": "FINETUNE", "unknown": {"x": 1}, "model": {"uuid4": "u", "name": "n", "pretrained": {"args": {"deep": 1}, "a": None}},
        "ds": {"comes_with_splits": {"train": True}, "list": [1, {"a": 2}], "empty": {}, "dirs": "x", "dirs2": "y"},
        "training_args": {"args": {"warmup_ratio": 0.0, "group_by_length": False, "optim_args": "eps=1e-3, foreach=None,fused=True"}},
        "peft": {"ratio": "0.3", "flag": "true"}})
    assert got == {
        "mode": '"finetune"', "model.name": '"n"', "model.pretrained.a": "null", "ds.splits.train": "true",
        "ds.list": '[1,{"a":2}]', "ds.empty": "{}", "ds.dirs2": '"y"', "training_args.args.warmup_steps": "0.0",
        "training_args.args.train_sampling_strategy": "null", "training_args.args.optim_args.eps": "0.001",
        "training_args.args.optim_args.foreach": "null", "training_args.args.optim_args.fused": "true",
        "peft.ratio": '"0.3"', "peft.flag": '"true"'}


def test_values_compare_by_meaning(spark):
    cases = [
        ("k", "1", "1.0", True), ("k", '"1"', "1", True), ("k", "true", "true", True), ("k", "true", "1", False),
        ("k", "true", '"true"', False), ("k", '"a"', '"a"', True), ("k", '"a"', '"b"', False), ("k", None, "null", True),
        ("k", None, "0.0", False), ("k", "null", "0", False), ("k", "[1]", "[1]", True), ("k", '"1e-3"', "0.001", True),
        ("training_args.args.label_smoothing_factor", None, "0.0", True),
        ("training_args.args.label_smoothing_factor", "0.1", None, False)]
    df = spark.createDataFrame(cases, "key string, a string, b string, same boolean")
    got = df.withColumn("got", C.same_value(F.col("key"), F.col("a"), F.col("b"))).collect()
    assert [(r["key"], r["a"], r["b"], r["got"]) for r in got] == cases


KV = "run int, key string, value string"


def test_drift_and_selfcheck(spark):
    unit = spark.createDataFrame([(r, k, v) for r in (1, 2) for k, v in (("a", "1"), ("b", '"x"'), ("c", "null"))], KV)
    ran = spark.createDataFrame([(1, "a", "1.0"), (1, "b", '"y"'), (2, "a", "2"), (2, "b", '"x"'), (2, "d", "5")], KV)
    drift = C.config_diff(ran, unit)
    assert {tuple(r) for r in drift.collect()} == {(1, "b", '"y"'), (2, "a", "2"), (2, "d", "5")}
    none = spark.createDataFrame([], KV)
    assert C.config_selfcheck(ran, unit, none, drift).count() == 0
    over = spark.createDataFrame([(2, "a", "9")], KV)
    assert {tuple(r) for r in C.config_selfcheck(ran, unit, over, drift).collect()} == {(2, "a", "2")}
    gone = C.config_diff(spark.createDataFrame([(1, "a", "1")], KV), unit.where("run = 1"))
    assert {tuple(r) for r in gone.collect()} == {(1, "b", "<absent>")}
    assert C.config_selfcheck(spark.createDataFrame([(1, "a", "1")], KV), unit.where("run = 1"), none, gone).count() == 0


def test_variants_number_by_first_appearance(spark):
    runs = spark.createDataFrame([(i, "spt", str(i % 2)) for i in range(1, 7)] + [(7, "xpe", "0")], "run int, method string, fold string")
    drift = spark.createDataFrame([(2, "a", "1"), (3, "a", "1"), (5, "a", "1"), (6, "a", "1"), (6, "b", "2")], "run int, key string, ran string")
    got = [tuple(r) for r in C.config_variants(runs, drift).orderBy("method", "variant").collect()]
    assert got == [("spt", 1, 1, 2, "0,1", False), ("spt", 2, 2, 3, "0,1", True), ("spt", 3, 6, 1, "0", False), ("xpe", 1, 7, 1, "0", True)]


def test_coverage_reports_missing_extra_and_several(spark):
    runs = spark.createDataFrame([("spt", 0, "v1"), ("spt", 1, "v1"), ("spt", 1, "v2"), ("xpe", 1, "v1"), ("spt", 9, "v1")],
                                 "method string, fold int, recipe string")
    matrix = spark.createDataFrame([("spt", None), ("xpe", 0)], "method string, pinned_fold int")
    expected = C.expand_matrix(matrix, spark.createDataFrame([(0,), (1,), (2,)], "fold int"))
    got = {(r["method"], r["fold"]): (r["status"], r["n_runs"], r["usual_recipe"]) for r in C.grid_coverage(
        expected, runs, cell=["method", "fold"]).collect()}
    assert got == {("spt", 1): ("several_recipes", 2, None), ("spt", 2): ("missing", 0, "v1"), ("spt", 9): ("extra", 1, None),
                   ("xpe", 0): ("missing", 0, "v1"), ("xpe", 1): ("extra", 1, None)}


def test_unfolded_cells_match(spark):
    runs = spark.createDataFrame([("spt", None, "v1")], "method string, fold int, recipe string")
    expected = runs.select("method", "fold")
    assert C.grid_coverage(expected, runs, cell=["method", "fold"]).count() == 0


def test_tracking_takes_the_first_hit(spark):
    runs = spark.createDataFrame([("u1", 1), ("u2", 2)], "uuid4 string, run int")
    log = spark.createDataFrame([("u1", "b", 2), ("u1", "a", 1)], "uuid4 string, path string, v int")
    got = {r["run"]: (r["path"], r["v"], r["problem"]) for r in C.join_tracking(runs, log).collect()}
    assert got == {1: ("a", 1, None), 2: (None, None, "no tracking record")}


RES = "method string, seed int, fold int, target_lang string, accuracy double, n bigint, llm string, time_id string"


def test_stream_keeps_the_latest_and_resumes(spark, tmp_path):
    landing, changes, check = (str(tmp_path / p) for p in ("landing", "changes", "check"))
    first = spark.createDataFrame([("xpe", 1, f, "a", 0.5, 100, "aya", "20260101_000000") for f in range(3)], RES)
    first.coalesce(1).write.mode("append").parquet(landing)

    def run():
        S.start_rollup(S.watch_results(spark, landing, first.schema), changes, check).awaitTermination()
        return S.rollup(spark, changes).first()

    assert run()["acc"] == 0.5
    later = spark.createDataFrame([("xpe", 1, 0, "a", 0.8, 100, "aya", "20260102_000000")], RES)
    older = spark.createDataFrame([("xpe", 1, 1, "a", 0.1, 100, "aya", "20251231_000000")], RES)
    later.unionByName(older).coalesce(1).write.mode("append").parquet(landing)
    r = run()
    assert abs(r["acc"] - 0.6) < 1e-12 and r["n_items"] == 300 and r["n_folds"] == 3
    batch = S.latest_cells(spark.read.parquet(landing).withColumn("path", F.lit("p")))
    cols = ["method", "seed", "fold", "target_lang", "accuracy"]
    assert sorted(map(tuple, batch.select(cols).collect())) == sorted(map(tuple, S.current_cells(spark, changes).select(cols).collect()))
    S.compact(spark, changes, str(tmp_path / "compact"))
    assert S.current_cells(spark, str(tmp_path / "compact")).count() == 3
    # The log goes on from the compacted table; a late file of an older run does not win.
    changes = str(tmp_path / "compact")
    stale = S.latest_cells(spark.createDataFrame([("xpe", 1, 0, "a", 0.2, 100, "aya", "20260101_120000")], RES).withColumn("path", F.lit("q")))
    stale.withColumn("batch", F.lit(5)).write.mode("append").partitionBy("batch").parquet(changes)
    assert {(r["fold"], r["accuracy"]) for r in S.current_cells(spark, changes).collect()} == {(0, 0.8), (1, 0.5), (2, 0.5)}


def test_documents_of_any_depth(spark):
    doc = {"x": 1}
    for i in range(12):
        doc = {f"k{i}": doc}
    text = json.dumps({"ds": doc, "other": {"y": "{{"}})
    docs = spark.createDataFrame([(1, text), (2, None), (3, "{}")], "run int, doc string")
    rows = C.flatten_documents(docs, ids=["run"], sections=["ds"]).collect()
    path = "ds." + ".".join(f"k{i}" for i in reversed(range(12))) + ".x"
    assert [(r["run"], r["key"], r["value"]) for r in rows if r["run"] == 1] == [(1, path, "1")]


def test_one_walk_and_no_join_per_level(spark):
    docs = spark.createDataFrame([(1, '{"a":{"b":{"c":{"d":1}}}}')], "run int, doc string")
    flat = C.flatten_documents(docs, ids=["run"])
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and "Join" not in plan and "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
    assert [tuple(r) for r in flat.collect()] == [(1, "a.b.c.d", "1")]


def test_leaves_are_written_as_the_engine_writes_json(spark):
    """Numbers, texts, lists and maps in lists against the built-in JSON type."""
    leaves = ["0", "-0", "12", "-7", "0.0", "-0.0", "2.50", "100.0", "1e-3", "1E-5", "2.5e10", "1e7", "123456.789e0", "0.1234567890123456789012345678901234567",
              '"a\\"\\\\\\n\\u00e9/"', '""', "true", "false", "null", "[]", '[1, 2.0, {"b": [null, "x"], "a": 1e2}]']
    docs = spark.createDataFrame([(k, f'{{"v": {x}}}') for k, x in enumerate(leaves)], "run int, doc string")
    ours = {r.run: r.value for r in C.flatten_documents(docs, ids=["run"]).collect()}
    assert C._walk("12345678901234567890", None, None)[0]["value"] == "12345678901234567890"
    kind, text = F.schema_of_variant("v"), F.to_json("v")
    engine = docs.select("run", F.variant_get(F.parse_json("doc"), "$.v", "variant").alias("v")).select(
        "run", F.when(kind.startswith("DECIMAL") & ~text.contains("."), F.concat(text, F.lit(".0"))).otherwise(text).alias("value"))
    assert ours == {r.run: r.value for r in engine.collect()}


def test_odd_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, "{}"), (3, "5"), (4, '{"a":{},"b":{"":1}}')], "run int, doc string")
    got = {tuple(r) for r in C.flatten_documents(docs, ids=["run"]).collect()}
    assert got == {(1, "", None), (2, "", "{}"), (3, "", "5"), (4, "a", "{}"), (4, "b.", "1")}
    deep = '{"k":' * 300 + "1" + "}" * 300
    row = C.flatten_documents(spark.createDataFrame([(1, deep)], "run int, doc string"), ids=["run"]).first()
    assert row.key == ".".join(["k"] * 300) and row.value == "1"
    for bad in ('{"a":1,"a":2}', '{"a":', '{"a":{"b":{"c":1}}}'):
        try:
            C.flatten_documents(spark.createDataFrame([(1, bad)], "run int, doc string"), ids=["run"], depth=2).collect()
            raise AssertionError(bad)
        except Exception as error:
            assert not isinstance(error, AssertionError)


def test_heavy_rows_go_into_tasks_of_bounded_length(spark, monkeypatch):
    """One partition that holds most rows counts, not the number of partitions."""
    from glossagrid import session

    monkeypatch.setattr(session, "SPREAD_ROWS", 100)
    rows = spark.range(2000).repartition(8, F.lit(1))
    most, total = session.spread(rows).groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    assert most <= 150 and total == 2000
    even = spark.range(0, 800, 1, 8)
    assert session.spread(even) is even and session.spread(spark.range(0)).count() == 0
