import math
import random

import pytest
from pyspark.sql import functions as F

from glossagrid.functions.checks import DataProblem
from glossagrid.operators import quality as Q, tables as T

ROW = "method string, seed int, fold int, target_lang string, accuracy double, n bigint"


def rows_of(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_folds_pool_by_item_count(spark):
    df = spark.createDataFrame([("xpe", 1, 0, "a", 0.5, 300), ("xpe", 1, 1, "a", 0.8, 100), ("xpe", 1, 2, "a", None, 300)], ROW)
    r = T.pool_folds(df).first()
    assert r["acc"] == pytest.approx((0.5 * 300 + 0.8 * 100) / 400)
    assert (r["n_items"], r["n_folds"]) == (400, 2)


def test_unfolded_rows_count_one_fold_and_null_keys_drop(spark):
    df = spark.createDataFrame([("xpe", 1, None, "a", 0.5, 204), ("xpe", None, None, "a", 0.9, 204)], ROW)
    got = T.pool_folds(df).collect()
    assert len(got) == 1 and got[0]["n_folds"] == 1
    assert T.pool_folds(df.drop("fold")).first()["n_folds"] == 1


def test_seed_deviation_is_the_sample_one_and_null_for_one_seed(spark):
    pooled = spark.createDataFrame(
        [("spt", 1, "a", 0.4, 900), ("spt", 2, "a", 0.6, 900), ("xpe", 1, "a", 0.7, 900)],
        "method string, seed int, target_lang string, acc double, n_items bigint")
    got = rows_of(T.seed_mean_std(pooled), "method")
    assert got[("spt",)]["seed_std"] == pytest.approx(math.sqrt(0.02))
    assert got[("xpe",)]["seed_std"] is None and got[("xpe",)]["n_seeds"] == 1


def _long(spark):
    return spark.createDataFrame(
        [("other", "a", 0.1, 0.01, 2, 900), ("xpe", "a", 0.2, 0.02, 2, 900), ("zero_shot", "a", 0.3, None, 0, 600),
         ("spt", "a", 0.4, 0.04, 2, 900), ("xpe", "b", 0.5, 0.05, 3, 300)],
        "method string, target_lang string, mean_acc double, seed_std double, n_seeds bigint, n_items bigint")


def test_wide_columns_accuracies_then_deviations_in_method_order(spark):
    wide = T.to_wide(_long(spark))
    assert wide.columns == ["target_lang", "zero_shot_acc", "spt_acc", "xpe_acc", "other_acc",
                            "spt_std", "xpe_std", "other_std", "n_seeds", "n_items"]
    got = rows_of(wide, "target_lang")
    assert got[("a",)]["n_seeds"] == 2 and got[("a",)]["n_items"] == 900
    assert got[("b",)]["spt_acc"] is None and got[("b",)]["n_items"] == 300


def test_seen_is_tri_state_and_clashes_fail(spark):
    wide = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "target_lang string, x int")
    seen, low = (spark.createDataFrame([(v,)], "lang string") for v in "ab")
    flagged = T.add_seen(wide, seen, low)
    assert flagged.columns == ["target_lang", "seen", "x"]
    assert {r["target_lang"]: r["seen"] for r in flagged.collect()} == {"a": 1, "b": -1, "c": 0}
    with pytest.raises(DataProblem):
        T.add_seen(wide, seen, seen)


def test_performance_group_sizes_of_122_languages(spark):
    order = list(range(122))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([(f"l{i:03d}", i / 1000) for i in order], "target_lang string, mean_acc double")
    sizes = {r["perf"]: r["count"] for r in T.performance_groups(df).groupBy("perf").count().collect()}
    assert sizes == {"high": 61, "mid": 31, "low": 30}


def test_half_counts_round_to_even(spark):
    df = spark.createDataFrame([(f"l{i}", float(i)) for i in range(5)], "target_lang string, mean_acc double")
    sizes = {r["perf"]: r["count"] for r in T.performance_groups(df).groupBy("perf").count().collect()}
    assert sizes == {"high": 2, "mid": 2, "low": 1}      # 2.5 rounds to 2


def test_tie_at_a_cut_is_reported_and_split_by_name(spark):
    df = spark.createDataFrame([("d", 0.9), ("c", 0.5), ("b", 0.5), ("a", 0.1)], "target_lang string, mean_acc double")
    tie = T.performance_ties(df).collect()
    assert [(r["cut"], r["last_in"], r["first_out"]) for r in tie] == [("high", "b", "c")]
    groups = {r["target_lang"]: r["perf"] for r in T.performance_groups(df).collect()}
    assert groups == {"d": "high", "b": "high", "c": "mid", "a": "low"}


def test_fractions_must_fit(spark):
    df = spark.createDataFrame([("a", 0.1)], "target_lang string, mean_acc double")
    for high, low in ((0.9, 0.2), (0.5, 0.0), (0.0, 0.5)):
        with pytest.raises(DataProblem):
            T.performance_groups(df, high, low)


def test_language_without_baseline_fails(spark):
    wide = spark.createDataFrame([("a", 1)], "target_lang string, seen int")
    ranked = spark.createDataFrame([("b", "high")], "target_lang string, perf string")
    with pytest.raises(Exception, match="no baseline result for a"):
        T.add_perf(wide, ranked).collect()


def test_baseline_ranks_over_all_languages_not_only_targets(spark):
    grid = spark.createDataFrame([("xpe", s, 0, lang, 0.5, 100) for s in (1, 2) for lang in ("a", "b")], ROW)
    zs = spark.createDataFrame([(lang, 0, acc, 100) for lang, acc in (("a", 0.1), ("b", 0.2), ("c", 0.8), ("d", 0.9))],
                               "target_lang string, fold int, accuracy double, n bigint")
    none = spark.createDataFrame([], "lang string")
    got = rows_of(T.lang_table(grid, seen=none, zero_shot=zs), "target_lang")
    assert set(got) == {("a",), ("b",)}
    assert got[("b",)]["perf"] == "mid" and got[("a",)]["perf"] == "low"


def test_missing_seed_fails(spark):
    df = spark.createDataFrame([("xpe", 1, 0, "a", 0.5, 1)], ROW)
    assert T.restrict_seeds(df, [1]).count() == 1
    with pytest.raises(DataProblem, match="2"):
        T.restrict_seeds(df, [1, 2])


def test_duplicates_name_their_runs(spark):
    df = spark.createDataFrame([("xpe", 1, 0, "a", 0.5, 1, "r1"), ("xpe", 1, 0, "a", 0.6, 1, "r2"),
                                ("xpe", 2, 0, "a", 0.6, 1, "r2")], ROW + ", run_name string")
    got = Q.duplicate_results(df).collect()
    assert sorted((r["run_name"], r["n_rows"], r["n_total"]) for r in got) == [("r1", 1, 2), ("r2", 1, 2)]


VALID = "method string, fold int, seed int, lr double, best_val_acc double, path string"


def test_search_keeps_the_last_rerun_and_drops_failures(spark):
    df = spark.createDataFrame([("spt", 0, 1, 0.1, 0.5, "a"), ("spt", 0, 1, 0.1, 0.9, "b"),
                                ("spt", 0, 2, 0.1, 0.7, "a"), ("spt", 0, 3, 0.1, None, "a")], VALID)
    r = T.search_table(df, "lr").first()
    assert r["n_seeds"] == 2 and r["mean_val_acc"] == pytest.approx(0.8)


def test_constant_swept_key_fails(spark):
    df = spark.createDataFrame([("spt", 0, s, 0.1, 0.5, f"p{i}") for i in range(6) for s in (1, 2, 3)], VALID)
    with pytest.raises(DataProblem, match="hardly varies"):
        T.search_table(df, "lr")
    assert T.search_table(df).count() == 1        # without a swept key reruns just collapse


def test_foldless_search_gets_fold_zero(spark):
    df = spark.createDataFrame([("spt", None, s, 0.1, 0.5, "p") for s in (1, 2)], VALID)
    assert T.search_table(df, "lr").first()["fold"] == 0
    assert T.search_table(df.drop("fold"), "lr").first()["n_seeds"] == 2


def test_best_takes_the_smaller_value_on_a_tie(spark):
    table = spark.createDataFrame([("spt", 0, 0.2, 3, 0.8, 0.1), ("spt", 0, 0.1, 3, 0.8, 0.1), ("spt", 0, 0.3, 3, 0.7, 0.1)],
                                  "method string, fold int, lr double, n_seeds bigint, mean_val_acc double, seed_std double")
    assert T.best_by_group(table, "lr").first()["lr"] == 0.1


LANGS = [("amh", -1), ("kac", -1), ("acm", 0), ("ceb", 0), ("ita", 1), ("pol", 1), ("deu", 1), ("fra", 1)]


def _tables(spark, sources, acc=0.5):
    data = [(src, "g1", lang, seen, 0.3, acc, acc + 0.02, 0.01, 0.01, 10) for src, langs in sources.items() for lang, seen in langs]
    return spark.createDataFrame(data, "source_group string, grid string, target_lang string, seen int, zero_shot_acc double, "
                                       "spt_acc double, xpe_acc double, spt_std double, xpe_std double, n_seeds bigint")


def test_target_groups_and_exclusion(spark):
    got = rows_of(T.target_source_table(_tables(spark, {"enarzho": LANGS}), exclude=["deu", "fra"]), "target_group")
    assert {k[0]: v["n_langs"] for k, v in got.items()} == {"low-perf": 2, "unseen": 4, "seen": 2, "all": 6}
    assert got[("low-perf",)]["spt_acc"] == pytest.approx(50.0)
    whole = rows_of(T.target_source_table(_tables(spark, {"enarzho": LANGS})), "target_group")
    assert whole[("seen",)]["n_langs"] == 4


def test_cell_is_left_out_where_a_source_cannot_cover_the_group(spark):
    short = [(lang, f) for lang, f in LANGS if lang not in ("ita", "pol")]
    got = T.target_source_table(_tables(spark, {"enarzho": LANGS, "aya_seen": short}), exclude=["deu", "fra"])
    cells = {(r["target_group"], r["source_group"]) for r in got.collect()}
    assert ("seen", "aya_seen") not in cells and ("all", "aya_seen") not in cells
    assert ("unseen", "aya_seen") in cells and ("seen", "enarzho") in cells


def test_high_sources_are_named_by_role_and_ordered_by_size(spark):
    sizes = spark.createDataFrame([("enarzho", 3), ("aya_high", 61)], "source_group string, n_sources bigint")
    got = T.target_source_table(_tables(spark, {"aya_high": LANGS, "enarzho": LANGS, "new": LANGS}), sizes=sizes)
    order = [r["source_group"] for r in got.where("target_group = 'all'").orderBy("source_rank").collect()]
    assert order == ["enarzho", "high-perf", "new"]


def test_auto_takes_perf_only_when_every_table_has_it(spark):
    tables = _tables(spark, {"enarzho": LANGS, "joshi5": LANGS})
    part = tables.withColumn("perf", F.when(F.col("source_group") == "enarzho", "low"))
    assert T.target_flavour(tables) == "seen" and T.target_flavour(part) == "seen"
    assert T.target_flavour(tables.withColumn("perf", F.lit("low"))) == "perf"
    with pytest.raises(DataProblem):
        T.target_flavour(part, "perf")


def test_runs_align_by_language_and_equal_names_are_numbered(spark):
    df = spark.createDataFrame([("xpe", "p1", "a", 0.1), ("xpe", "p2", "a", 0.2), ("xpe", "p2", "b", 0.3)],
                               "run_name string, path string, target_lang string, accuracy double")
    got = rows_of(T.align_runs(df), "target_lang")
    assert got[("a",)] == {"target_lang": "a", "xpe": 0.1, "xpe#2": 0.2} and got[("b",)]["xpe"] is None
    with pytest.raises(DataProblem):
        T.align_runs(df.unionByName(df.limit(1)))


def test_first_letter_wins_a_score_tie(spark):
    df = spark.createDataFrame([("t", "A", 1, 1, 0, 0), ("t", "B", 1, 1, 0, 0)], "task string, gold string, a int, b int, c int, d int")
    r = T.score_items(df, task="task", gold="gold", scores={x: x.lower() for x in "ABCD"}).first()
    assert (r["accuracy"], r["n"]) == (0.5, 2)


def test_entry_rules(spark):
    groups = spark.createDataFrame([("joshi5", "deu", 0)], "group string, lang string, ord int")
    entries = spark.createDataFrame([
        ("ok", "joshi5", 0, "m/b/x/fold0/t", "finetune", True, None, None),
        ("bare", None, None, "m/b/x/t", "test", None, None, None),
        ("nogroup", None, None, "m/b/x/t", "finetune", None, True, None),
        ("unknown", "zzz", None, "m/b/x/t", "test", None, None, None),
        ("unfolded", "joshi5", 1, "m/b/x/t", "test", None, None, "u"),
        ("both", "joshi5", None, "m/b/x/t", "finetune", True, True, None),
        ("mode", "joshi5", None, "m/b/x/t", "train", None, None, None)],
        "name string, source_group string, fold int, dirs string, mode string, separate_test boolean, tune_only boolean, adapter string")
    got = sorted(tuple(r) for r in Q.entry_violations(entries, groups).collect())
    assert got == [("both", "exclusive_shapes"), ("mode", "mode_mismatch"), ("nogroup", "missing_source_group"),
                   ("unfolded", "fold_on_unfolded_path"), ("unknown", "unknown_source_group")]


def test_target_groups_may_be_given(spark):
    rows = [("s1", "g", "a", 1, 0.5, 2), ("s1", "g", "b", 0, 0.7, 2)]
    tables = spark.createDataFrame(rows, "source_group string, grid string, target_lang string, seen int, xpe_acc double, n_seeds int")
    got = T.target_source_table(tables, targets={"first": "target_lang = 'a'", "good": "xpe_acc > 0.4"})
    assert {(r["target_group"], r["n_langs"], r["target_rank"]) for r in got.collect()} == {("first", 1, 0), ("good", 2, 1)}
