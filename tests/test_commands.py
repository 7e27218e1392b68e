"""The command line end to end over small files."""

import pytest

from glossagrid.__main__ import main
from glossagrid.functions.checks import DataProblem


def _run_file(root, run, body, name="separate_test.csv"):
    (root / run).mkdir(parents=True)
    (root / run / name).write_text(body)


def _grid(root, source, accs):
    for seed in (10, 11):
        for fold in (0, 1):
            lines = "".join(f"xpe,{seed},{fold},aya,{lang},{acc + seed / 1000},100\n" for lang, acc in accs.items())
            _run_file(root / f"g1.{source}", f"2026010{seed - 9}_00000{fold}_xpe_f{fold}_s{seed}",
                      "method,seed,fold,llm,metric_group,accuracy,n\n" + lines)


def test_runs_to_language_tables_to_target_table(spark, tmp_path):
    accs = {"deu_Latn": 0.9, "ita_Latn": 0.8, "amh_Ethi": 0.3, "kac_Latn": 0.2}
    _grid(tmp_path, "enarzho", accs)
    _run_file(tmp_path / "zs", "20260101_000000_zs", "metric_group,accuracy,n,llm\n" + "".join(
        f"{lang},{acc / 2},100,aya\n" for lang, acc in accs.items()), "test.csv")
    group = str(tmp_path / "g1.enarzho")
    main(["lang-table", group, "--zero-shot-path", str(tmp_path / "zs")])
    table = {r["target_lang"]: r for r in spark.read.option("header", "true").csv(f"{group}/lang_table.csv").collect()}
    assert list(table["deu_Latn"].asDict()) == [
        "target_lang", "seen", "perf", "zero_shot_acc", "xpe_acc", "xpe_std", "n_seeds", "n_items"]
    assert table["deu_Latn"]["seen"] == "1" and table["amh_Ethi"]["seen"] == "0"
    assert table["deu_Latn"]["perf"] == "high" and table["kac_Latn"]["perf"] == "low"
    assert float(table["deu_Latn"]["xpe_acc"]) == pytest.approx(0.9105) and table["deu_Latn"]["n_items"] == "200"

    main(["target-source-table", str(tmp_path), "--run-group", "g1", "--out", str(tmp_path / "ts")])
    cells = {r["target_group"]: r for r in spark.read.option("header", "true").csv(str(tmp_path / "ts")).collect()}
    assert set(cells) == {"low-perf", "all wo high-perf", "high-perf wo j5", "all wo j5"}
    assert cells["high-perf wo j5"]["n_langs"] == "1" and cells["all wo j5"]["grid"] == "g1"
    with pytest.raises(DataProblem, match="seeds"):
        main(["lang-table", group, "--seeds", "10,99"])


def test_repeated_cells_fail_and_seedless_runs_align(spark, tmp_path):
    body = "method,seed,fold,llm,metric_group,accuracy,n,name\nxpe,1,0,aya,deu_Latn,0.5,100,r{0}\n"
    for i in (1, 2):
        _run_file(tmp_path / "dup", f"2026010{i}_000000_xpe", body.format(i))
    with pytest.raises(DataProblem, match="same cell"):
        main(["lang-table", str(tmp_path / "dup")])
    for i, acc in ((1, 0.5), (2, 0.7)):
        _run_file(tmp_path / "plain", f"2026010{i}_000000_xpe", f"method,seed,llm,metric_group,accuracy,n,name\nxpe,,aya,deu_Latn,{acc},9,xpe\n")
    main(["lang-table", str(tmp_path / "plain")])
    row = spark.read.option("header", "true").csv(str(tmp_path / "plain" / "lang_table.csv")).first()
    assert row.asDict() == {"target_lang": "deu_Latn", "xpe": "0.5", "xpe#2": "0.7"}


def test_search(spark, tmp_path):
    for i, (lr, acc) in enumerate(((0.1, 0.4), (0.2, 0.6))):
        for seed in (1, 2):
            _run_file(tmp_path, f"2026010{i + 1}_00000{seed}_spt", f"method,seed,fold,lr,accuracy\nspt,{seed},0,{lr},{acc}\n",
                      "eval_validation_after_train.csv")
    main(["search-table", str(tmp_path), "--group-by", "lr"])
    rows = spark.read.option("header", "true").csv(str(tmp_path / "lr_search_table.csv")).collect()
    assert [(r["lr"], r["n_seeds"]) for r in rows] == [("0.1", "2"), ("0.2", "2")]


def test_records_to_folds_to_chat(spark, tmp_path):
    src, out, split, chat = (str(tmp_path / p) for p in ("src", "prompts", "folds", "chat"))
    spark.range(60).selectExpr(
        "array('de','en')[id % 2] lang", "'test' split", "concat('l', id div 20) link", "cast(id div 2 % 10 as int) question_number",
        "'p' flores_passage", "' q ' question", "'1' mc_answer1", "'2' mc_answer2", "'3' mc_answer3", "'4' mc_answer4",
        "'1' correct_answer_num").write.parquet(src)
    main(["reframe-mcqa", src, out])
    main(["split-folds", out, split, "--train", "15", "--val", "5", "--test", "10"])
    rows = spark.read.parquet(split)
    assert rows.count() == 180 and rows.where("split = 'test'").count() == 60
    for _ in range(2):
        main(["wrap-chat", split, chat, "--template", "gemma_prefill"])
    assert spark.read.parquet(chat).count() == 180
    assert spark.read.parquet(chat).where("text like '%model\nAnswer：'").count() == 180


def test_store_to_cluster_table(spark, tmp_path):
    src, out = str(tmp_path / "store"), str(tmp_path / "out")
    spark.range(80).selectExpr(
        "concat('r/peft-', array('xpe','spt')[id % 2], '-x@seen@l', id % 4 div 2, '_', array('Latn','Cyrl')[id % 4 div 2], '@0') key",
        "array(cast(id % 4 div 2 + sin(id) as float), cast(cos(id) as float)) embedding").write.parquet(src)
    main(["cluster-quality", src, out, "--n-resamples", "20"])
    row = spark.read.option("header", "true").csv(out).first().asDict()
    assert row["xpe_n_samples"] == "40" and row["spt_n_clusters"] == "2"
    assert float(row["diff_davies_bouldin"]) == pytest.approx(float(row["xpe_davies_bouldin"]) - float(row["spt_davies_bouldin"]))
    assert float(row["diff_db_ci_l"]) <= float(row["diff_db_ci_u"]) and 0 < float(row["diff_db_p"]) <= 1


def test_cloze_topics_and_tokens(spark, tmp_path):
    src, out, topics, tok, stats = (str(tmp_path / p) for p in ("src", "cloze", "topics", "tok", "stats"))
    spark.range(12).selectExpr(
        "array('de','en')[id % 2] lang", "array('train','eval')[id % 3 div 2] split", "id div 2 item", *[f"'s{i}' input_sentence_{i}" for i in range(1, 5)],
        "'x' sentence_quiz1", "if(id = 5, null, 'y') sentence_quiz2", "1 answer_right_ending").write.parquet(src)
    main(["reframe-cloze", src, out])
    assert spark.read.parquet(out).count() == 11
    assert {r[0] for r in spark.read.parquet(out).select("split").distinct().collect()} == {"train", "validation"}
    assert spark.read.option("header", "true").csv(f"{out}.rejected.csv").count() == 1
    spark.createDataFrame([("de", "t", "travel", "a b c"), ("en", "t", "sports", "d")], "lang string, split string, category string, text string").write.parquet(f"{src}2")
    main(["label-topics", f"{src}2", topics])
    assert {(r["lang"], r["labels"]) for r in spark.read.parquet(topics).collect()} == {("de", 1), ("en", 3)}
    for _ in range(2):
        main(["tokenize", topics, tok, "--text", "inputs"])
    assert {r["lang"]: r["length"] for r in spark.read.parquet(tok).collect()} == {"de": 5, "en": 3}
    main(["length-stats", tok, stats])
    assert spark.read.option("header", "true").csv(stats).count() == 2
