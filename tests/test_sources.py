import pytest
from pyspark.sql import functions as F

from glossagrid.functions.checks import DataProblem
from glossagrid.operators import folds, tables as T
from glossagrid.sources import datasets as D, embeddings as E, results as R


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_results_bind_by_name_over_differing_headers(spark, tmp_path):
    _write(tmp_path / "20260101_000000_xpe_f0" / "separate_test_x.csv",
           "method,seed,fold,llm,metric_group,accuracy,n\nxpe,10,0,aya,deu_Latn,0.5,300\nxpe,10,0,aya,kat_Geor,,\n")
    _write(tmp_path / "20260102_000000_spt_f1" / "separate_test.csv",
           "n,accuracy,metric_group,llm,fold,seed,method,lr\n300,0.25,deu_Latn,aya,1.0,11,spt,0.5\n")
    _write(tmp_path / "20260103_000000_zs" / "test.csv", "method,seed,metric_group,accuracy,n,llm\nzero,,deu_Latn,0.3,900,aya\n")
    _write(tmp_path / "old" / "20260104_000000_dual_f2_s7" / "raw.csv",
           "run_name,src_tag,fold,seed,target_lang,accuracy,n,llm\n20260104_000000_dual_f2_s7,enarzho,2,7,deu_Latn,0.75,300,aya\n")
    _write(tmp_path / "20260101_000000_xpe_f0" / "notes.csv", "a,b\n1,2\n")
    rows = R.collect_results(spark, str(tmp_path))
    got = {(r["method"], r["seed"], r["fold"], r["target_lang"]): r for r in rows.collect()}
    assert set(got) == {("xpe", 10, 0, "deu_Latn"), ("xpe", 10, 0, "kat_Geor"), ("spt", 11, 1, "deu_Latn"),
                        ("zero", None, None, "deu_Latn"), ("dual", 7, 2, "deu_Latn")}
    assert got[("spt", 11, 1, "deu_Latn")]["accuracy"] == 0.25 and got[("spt", 11, 1, "deu_Latn")]["lr"] == "0.5"
    assert got[("dual", 7, 2, "deu_Latn")]["source_group"] == "enarzho"
    assert got[("xpe", 10, 0, "kat_Geor")]["accuracy"] is None
    assert T.has_seed_axis(rows) and T.pool_folds(rows).count() == 3


def test_headers_with_quotes_and_records_that_are_too_long(spark, tmp_path):
    _write(tmp_path / "a" / "test.csv", '"method","note, long","say ""n""",n\nxpe,"x, ""y""",2,3\nspt,,,\n')
    _write(tmp_path / "b" / "test.csv", "method,n\ndual,4\n")
    rows = R.read_by_header(spark, str(tmp_path))
    assert set(rows.columns) == {"method", "note, long", 'say "n"', "n", "path", "block", "line"}
    got = {r["method"]: (r["note, long"], r['say "n"'], r["n"]) for r in rows.collect()}
    assert got == {"xpe": ('x, "y"', "2", "3"), "spt": (None, None, None), "dual": (None, None, "4")}
    _write(tmp_path / "b" / "test.csv", "method,n\ndual,4,5\n")
    with pytest.raises(Exception, match="beyond the header"):
        R.read_by_header(spark, str(tmp_path)).collect()


def test_missing_files_columns_and_backbone(spark, tmp_path):
    with pytest.raises(DataProblem, match="nothing named separate_test"):
        R.collect_results(spark, str(tmp_path))
    _write(tmp_path / "r" / "test.csv", "method,metric_group,accuracy,n\nxpe,deu,0.5,3\n")
    with pytest.raises(DataProblem, match="llm"):
        R.collect_results(spark, str(tmp_path))
    with pytest.raises(DataProblem, match="seed"):
        R.collect_results(spark, str(tmp_path), backbone="aya")
    assert R.collect_results(spark, str(tmp_path), backbone="aya", required=R.ZERO_SHOT_REQUIRED).first()["llm"] == "aya"


def test_validation_files_take_the_latest_run(spark, tmp_path):
    for stamp, acc in (("20260101_000000", 0.4), ("20260102_000000", 0.6)):
        _write(tmp_path / f"{stamp}_spt" / "eval_validation_after_train.csv", f"method,seed,lr,accuracy\nspt,10,0.1,{acc}\n")
    rows = R.collect_validation(spark, str(tmp_path))
    table = T.search_table(rows, order=["path", "block", "line"])
    assert [r["mean_val_acc"] for r in table.collect()] == [0.6]


def test_tables_scan_with_grid_and_source(spark, tmp_path):
    text = "target_lang,seen,xpe_acc,xpe_std,n_seeds,n_items\ndeu_Latn,1,0.5,,10,900\n"
    for folder in ("14a_grid.enarzho", "14a_grid.zero", "26a.b+c.aya_high", "99_other.joshi5"):
        _write(tmp_path / folder / "lang_table.csv", text)
    got = R.scan_tables(spark, str(tmp_path), grids=["14a_grid", "26a.b+c"])
    assert {(r["grid"], r["source_group"]) for r in got.collect()} == {("14a_grid", "enarzho"), ("26a.b+c", "aya_high")}
    assert got.first()["xpe_std"] is None and got.first()["n_seeds"] == 10
    _write(tmp_path / "26a.enarzho" / "lang_table.csv", text)
    with pytest.raises(DataProblem, match="enarzho"):
        R.scan_tables(spark, str(tmp_path))


def _dataset(spark, n=120):
    return spark.range(n).select(
        F.element_at(F.array(F.lit("de"), F.lit("en"), F.lit("fr")), (F.col("id") % 3 + 1).cast("int")).alias("lang"),
        (F.col("id") % 2).cast("int").alias("fold"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"),
        F.col("id").alias("x"))


def test_write_verify_discover_and_prune(spark, tmp_path):
    root = str(tmp_path / "data")
    report = D.write_verified(_dataset(spark), root)
    assert report.count() == 12 and report.agg(F.sum("n_written")).first()[0] == 120
    parts = D.discover_partitions(spark, root)
    assert parts.count() == 12
    assert [r[0] for r in D.languages_with(parts, exclude=["en"], fold=0).collect()] == ["de", "fr"]
    one = folds.select_partition(spark.read.parquet(root), lang="en", fold=1)
    assert one.count() == 20
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan
    with pytest.raises(DataProblem):
        D.discover_partitions(spark, str(tmp_path / "absent"))


def test_the_rows_are_computed_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        calls.add(1)
        return x

    rows = _dataset(spark).withColumn("x", counted.asNondeterministic()("x"))
    report = D.write_verified(rows, str(tmp_path / "data"))
    assert report.where("ok").count() == 12 and report.agg(F.sum("n_expected")).first()[0] == 120
    assert calls.value == 120


def test_observed_counts_name_a_partition_that_lost_a_file(spark, tmp_path):
    from pyspark.sql import Observation

    root, seen = tmp_path / "data", Observation()
    D.write_partitioned(_dataset(spark), str(root), observed=seen)
    for lost in (root / "lang=fr" / "fold=1" / "split=train").glob("*.parquet"):
        lost.unlink()
    bad = D.verify_observed(_dataset(spark), str(root), seen).where("not ok").collect()
    assert [(r["lang"], r["fold"], r["split"], r["n_written"]) for r in bad] == [("fr", "1", "train", 0)]


def test_verification_reports_lost_rows(spark, tmp_path):
    root = str(tmp_path / "data")
    D.write_partitioned(_dataset(spark, 119), root)
    bad = D.verify_written(_dataset(spark, 120), root).where("not ok").collect()
    assert [(r["lang"], r["fold"], r["split"], r["n_expected"] - r["n_written"]) for r in bad] == [("fr", "1", "train", 1)]


def test_second_append_writes_nothing(spark, tmp_path):
    root = str(tmp_path / "data")
    rows = _dataset(spark)
    assert D.append_missing(rows.where("lang = 'de'"), root).count() == 4
    assert D.append_missing(rows, root).count() == 8
    assert D.append_missing(rows, root).count() == 0
    assert spark.read.parquet(root).count() == 120


def test_rows_without_a_fold_round_trip_and_are_not_written_twice(spark, tmp_path):
    root = str(tmp_path / "data")
    rows = _dataset(spark).withColumn("fold", F.when(F.col("fold") == 1, 1))
    assert D.write_verified(rows, root).where("fold is null and ok").count() == 6
    assert D.append_missing(rows, root).count() == 0
    unfolded = folds.select_partition(spark.read.parquet(root), lang="de")
    assert unfolded.count() == 20


def test_prepare_and_manifest(spark, tmp_path):
    root = str(tmp_path / "data")
    D.write_partitioned(_dataset(spark), root)
    out = D.prepare_dataset(spark, root, "de", {"train": "validation"})
    assert {r[0] for r in out.select("split").distinct().collect()} == {"validation"}
    with pytest.raises(DataProblem):
        D.prepare_dataset(spark, root, "de", {"dev": "validation"})
    listed = {r["config_name"]: r["data_files"] for r in D.manifest(_dataset(spark)).collect()}
    assert '"path":"en/test-*"' in listed["en"] and '"path":"en/train-*"' in listed["en"]


def test_many_layouts_and_quoted_line_breaks(spark, tmp_path):
    for i in range(501):
        folder = tmp_path / "runs" / f"r{i:03d}"
        folder.mkdir(parents=True)
        (folder / "test.csv").write_text(f'target_lang,"extra{i}",accuracy\n"two\nlines",x{i},0.5\nplain,,0.25\n')
    rows = R.read_by_header(spark, str(tmp_path / "runs"))
    got = rows.where("path like '%/r077/%'").orderBy("line").select("target_lang", "extra77", "accuracy", "extra76").collect()
    assert [tuple(r) for r in got] == [("two\nlines", "x77", "0.5", None), ("plain", None, "0.25", None)]
    assert rows.count() == 1002


def test_tokenized_copies_are_told_apart(spark):
    parts = spark.createDataFrame([("de", "train", None), ("de", "test", "words"), ("en", "train", None)], "lang string, split string, tokenizer string")
    assert {tuple(r) for r in D.saved_splits(parts).collect()} == {("de", "train"), ("en", "train")}
    assert D.saved_splits(parts, tokenized=True).count() == 3 and D.saved_splits(parts.drop("tokenizer")).count() == 3


def test_empty_folders_are_discovered(spark, tmp_path):
    root = str(tmp_path / "data")
    D.write_partitioned(_dataset(spark), root)
    (tmp_path / "data" / "lang=xx" / "fold=0" / "split=train").mkdir(parents=True)
    found = D.discover_partitions(spark, root)
    assert found.where("lang = 'xx'").count() == 1
    plan = found._jdf.queryExecution().toString()
    assert "FileScan" not in plan


def test_metrics_map_discovers_metrics_and_saves(spark, tmp_path):
    docs = spark.createDataFrame([('{"belebele_kat_Geor": {"acc,none": 0.25, "alias": "x"}, "belebele_deu_Latn": {"acc,none": 0.5}}',)],
                                 "metrics string")
    table = R.metrics_table(docs)
    assert table.columns == ["language", "task", "acc", "alias"]
    assert [(r["language"], r["acc"]) for r in table.collect()] == [("deu_Latn", 0.5), ("kat_Geor", 0.25)]
    R.save_metrics(table, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m" / "json")).count() == 2


def test_shards_merge_in_order(spark):
    schema = "key string, row_id int"
    a, b = spark.createDataFrame([("k2", 1), ("k3", 2)], schema), spark.createDataFrame([("k1", 3), ("k2", 4)], schema)
    got = [tuple(r) for r in E.merge_shards(a, b).orderBy("key_order", "shard", "row_id").select("key", "shard", "row_id").collect()]
    assert got == [("k2", 1, 1), ("k2", 2, 4), ("k3", 1, 2), ("k1", 2, 3)]
    assert E.select_embeddings(a, labels=["k3"]).count() == 1
    assert E.select_embeddings(a).count() == 2


def test_append_by_name(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int")
    assert {tuple(r) for r in R.union_results([a, b]).collect()} == {(1, 2), (3, None)}
