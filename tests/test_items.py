import pytest
from pyspark.sql import functions as F

from glossagrid.functions import names as N, text as X
from glossagrid.functions.checks import DataProblem
from glossagrid.operators import folds, prompts, tokens
from glossagrid.constants import TOPIC_LABELS

def _mcqa(spark, question, correct):
    return spark.createDataFrame(
        [("x", "l", 1, "p ", question, "1", "2", "3", "4", correct)],
        "lang string, link string, question_number int, flores_passage string, question string, mc_answer1 string, "
        "mc_answer2 string, mc_answer3 string, mc_answer4 string, correct_answer_num string")


@pytest.mark.parametrize("question", [" q ", " q ", "　q\x1f", "\n\tq\x85", "q"])
def test_mcqa_prompt_strips_blanks_of_any_script(spark, question):
    r = prompts.reframe_mcqa(_mcqa(spark, question, "3")).first()
    assert r["text"] == "P: p \nQ: q\nA: 1\nB: 2\nC: 3\nD: 4\nAnswer："
    assert question.strip() == "q" and r["answer_label"] == "C"


@pytest.mark.parametrize("correct", ["0", "5"])
def test_answer_number_outside_the_choices_has_no_label(spark, correct):
    assert prompts.bad_labels(prompts.reframe_mcqa(_mcqa(spark, "q", correct))).count() == 1


def test_cloze_letters_are_two_distinct_and_repeatable(spark):
    rows = spark.range(200).select(
        F.lit("x").alias("lang"), F.col("id").alias("item"), *[F.lit(f"s{i}").alias(f"input_sentence_{i}") for i in range(1, 5)],
        F.lit("e1").alias("sentence_quiz1"), F.lit("e2").alias("sentence_quiz2"), (F.col("id") % 2 + 1).alias("answer_right_ending"))
    first = sorted(map(tuple, prompts.reframe_cloze(rows, seed=1).collect()))
    assert first == sorted(map(tuple, prompts.reframe_cloze(rows.repartition(5), seed=1).collect()))
    assert first != sorted(map(tuple, prompts.reframe_cloze(rows, seed=2).collect()))
    seen = set()
    for _, item, text, label in first:
        lines = text.split("\n")
        a, b = lines[5][0], lines[6][0]
        assert lines[:5] == ["s1", "s2", "s3", "s4", ""] and lines[5][1:] == ": e1" and lines[6][1:] == ": e2"
        assert a != b and label == (a if item % 2 == 0 else b) and text.endswith("\nAnswer：")
        seen.add((a, b))
    assert len(seen) == 12


def test_chat_layouts(spark):
    plain = "P: p\nAnswer："
    df = spark.createDataFrame([(plain, 1)], "text string, x int")
    def wrap(layout):
        return prompts.chat_wrap(df, layout).first()

    assert wrap("gemma")["text"] == f"<start_of_turn>user\n{plain}<end_of_turn>\n<start_of_turn>model\n"
    assert wrap("gemma4")["text"] == f"<|turn>user\n{plain}<turn|>\n<|turn>model\n<|channel>thought\n<channel|>"
    assert wrap("gemma_prefill")["text"] == "<start_of_turn>user\nP: p<end_of_turn>\n<start_of_turn>model\nAnswer："
    assert wrap("gemma4_prefill")["text"].endswith("<channel|>Answer：") and wrap("gemma4_prefill")["x"] == 1
    bad = spark.createDataFrame([("no cue",)], "text string")
    with pytest.raises(Exception, match="answer cue"):
        prompts.chat_wrap(bad, "gemma_prefill").collect()


def test_topic_labels(spark):
    df = spark.createDataFrame([(i, c, "t") for i, c in enumerate(TOPIC_LABELS)], "index_id int, category string, text string")
    out = prompts.label_topics(df)
    assert out.columns == ["index_id", "labels", "inputs"]
    assert all(r["labels"] == r["index_id"] for r in out.collect())
    with pytest.raises(Exception, match="unknown category weather"):
        prompts.label_topics(df.withColumn("category", F.lit("weather"))).collect()


def test_split_map_swaps_drops_and_fails_on_missing(spark):
    df = spark.createDataFrame([("train", 1), ("validation", 2), ("extra", 3)], "split string, x int")
    out = prompts.remap_splits(df, {"train": "validation", "validation": "train"})
    assert {(r["split"], r["x"]) for r in out.collect()} == {("validation", 1), ("train", 2)}
    with pytest.raises(DataProblem):
        prompts.remap_splits(df, {"test": "train"})


def _keys(spark):
    return spark.range(900).select(F.concat(F.lit("link"), F.floor(F.col("id") / 10)).alias("link"),
                                   (F.col("id") % 10).cast("int").alias("question_number"))


def test_folds_tile_and_are_disjoint(spark):
    keys = _keys(spark)
    got = folds.assign_fold_splits(keys).collect()
    assert len(got) == 2700
    by = {}
    for link, q, fold, split in got:
        by.setdefault((fold, split), set()).add((link, q))
    for f in range(3):
        assert [len(by[(f, s)]) for s in ("train", "validation", "test")] == [500, 100, 300]
        assert not by[(f, "train")] & by[(f, "test")] and not by[(f, "validation")] & by[(f, "test")]
    assert len(set().union(*(by[(f, "test")] for f in range(3)))) == 900


def test_shares_of_a_number_of_items_that_no_fold_divides(spark):
    for n in (52, 3):
        got = folds.assign_fold_splits(spark.range(n), ["id"], n_splits=5, val_share=10, seed=11).collect()
        test, val = n // 5, n // 10
        for f in range(5):
            of = {s: {r.id for r in got if (r.fold, r.split) == (f, s)} for s in ("test", "validation", "train")}
            assert [len(of[s]) for s in ("test", "validation", "train")] == [test, val, n - test - val]
        tested = [r.id for r in got if r.split == "test"]
        assert len(tested) == len(set(tested)) == 5 * test


def test_folds_do_not_depend_on_order_copies_or_partitions(spark):
    keys = _keys(spark)
    a = sorted(map(tuple, folds.assign_fold_splits(keys).collect()))
    shuffled = keys.unionByName(keys.where("question_number = 1")).orderBy(F.rand(3)).repartition(7)
    assert a == sorted(map(tuple, folds.assign_fold_splits(shuffled).collect()))
    assert a != sorted(map(tuple, folds.assign_fold_splits(keys, seed=1).collect()))


def test_fold_sizes_must_fit(spark):
    with pytest.raises(Exception, match="fold sizes do not fit"):
        folds.assign_fold_splits(_keys(spark).where("question_number < 9")).collect()
    with pytest.raises(Exception, match="fold sizes do not fit"):
        folds.assign_fold_splits(_keys(spark), train=400, val=100, test=300).collect()


def test_parallel_report_and_drop(spark):
    items = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "x", 1), ("c", "x", 1), ("c", "y", 1), ("c", "z", 1),
                                   ("d", "x", 1), ("d", "y", 1)], "lang string, link string, question_number int")
    report = folds.parallel_report(items)
    assert {r["lang"]: (r["n_missing"], r["n_extra"], r["ok"]) for r in report.collect()} == {
        "a": (0, 0, True), "b": (1, 0, False), "c": (0, 1, False), "d": (0, 0, True)}
    assert {r["lang"] for r in folds.drop_unparallel(items, report).collect()} == {"a", "d"}
    with pytest.raises(DataProblem):
        folds.check_parallel(report)


def test_task_ids_follow_sorted_languages(spark):
    rows = spark.createDataFrame([("fr", 1), ("de", 2), ("en", 3)], "lang string, x int")
    assert {r["lang"]: r["task_ids"] for r in folds.task_ids(rows).collect()} == {"de": 0, "en": 1, "fr": 2}
    assert {r["lang"]: r["task_ids"] for r in folds.task_ids(rows, ["fr", "en"]).collect()} == {"en": 0, "fr": 1}
    with pytest.raises(DataProblem, match="no rows of"):
        folds.task_ids(rows, ["fr", "xx"])


def test_fold_of_an_unfolded_dataset_fails(spark):
    with pytest.raises(DataProblem):
        folds.select_partition(spark.createDataFrame([("a", 1)], "lang string, x int"), lang="a", fold=0)


def test_truncation_share_and_encoder(spark):
    df = spark.createDataFrame([(i, "a b c d e") for i in range(100)], "id int, text string")
    cut = tokens.tokenize(df, tokens.pattern_tokenizer(), max_length=4, truncate=True).first()
    assert cut["tokens"] == ["a", "b"] and cut["length"] == 4 and not cut["too_long"]
    assert 20 < tokens.tokenize(df, tokens.pattern_tokenizer(), share=0.5, ids=["id"]).count() < 80
    vocab = {w: i for i, w in enumerate("abcde")}
    ids = tokens.tokenize(df, tokens.encoder_tokenizer(lambda ts: [[vocab[w] for w in t.split()] for t in ts])).first()
    assert ids["tokens"] == [0, 1, 2, 3, 4] and ids["length"] == 7


def test_vocabulary_limits_and_mixed(spark):
    df = spark.createDataFrame([("eng_Latn", 1, "a b"), ("eng_Latn", 2, "z"), ("rus_Cyrl", 1, "b c"), ("bul_Cyrl", 1, "c d"), ("xx", 1, "u")],
                               "lang string, k int, text string")
    whole = {r["token"]: r["group"] for r in tokens.vocabulary_by_script(df, tokens.pattern_tokenizer()).collect()}
    assert whole == {"a": "eng_Latn", "b": "Mixed", "z": "eng_Latn", "c": "Cyrl", "d": "Cyrl", "u": "UNK"}
    first = tokens.vocabulary_by_script(df, tokens.pattern_tokenizer(), max_texts=1, max_tokens=1, order=["k"]).collect()
    assert {r["token"] for r in first} == {"a", "b", "c", "u"}


def test_names(spark):
    df = spark.createDataFrame([("20260522_170730_xpe_f0_s10", "a/b/de/fold2/tok", "lab/m-Peft-XPE-x@low-perf@ace_Arab@12")],
                               "run string, dirs string, key string")
    r = df.select(
        N.run_label(F.col("run")), N.method_of_run(F.col("run")), N.fold_of_path(F.col("dirs")), N.lang_of_key(F.col("key")),
        N.layer_of_key(F.col("key")), N.has_method(F.col("key"), "xpe"), N.has_method(F.col("key"), "spt"),
        N.script_of(N.lang_of_key(F.col("key"))), N.script_of(F.lit("abc_Abcde")), N.script_of(F.lit("a_1234"))).first()
    assert tuple(r) == ("xpe_f0_s10", "xpe", 2, "ace_Arab", 12, True, False, "Arab", "abc_Abcde", "a_1234")


def test_strip_matches_python_on_every_blank(spark):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    df = spark.createDataFrame([(b + "x" + b,) for b in blanks], "t string")
    assert {r[0] for r in df.select(X.strip(F.col("t"))).collect()} == {"x"}


def test_null_fields_are_reported_and_not_dropped(spark):
    rows = spark.createDataFrame(
        [("de", "l", 1, "p", "q", "1", "2", "3", "4", "1"), ("de", "l", 2, None, "q", "1", None, "3", "4", "1"),
         ("de", "l", 3, "p", "q", "1", "2", "3", "4", "9")],
        "lang string, link string, question_number int, flores_passage string, question string, mc_answer1 string, "
        "mc_answer2 string, mc_answer3 string, mc_answer4 string, correct_answer_num string")
    out = prompts.reframe_mcqa(rows)
    assert [r["text"] is None for r in out.orderBy("question_number").collect()] == [False, True, False]
    assert [r["question_number"] for r in prompts.bad_prompts(out).orderBy("question_number").collect()] == [2, 3]
