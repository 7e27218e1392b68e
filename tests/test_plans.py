"""Plans the operators must keep: pushed filters, pruned columns, no pair joins, no
Python in row-wise work, and one read of a large input."""

import pytest

import __spark_entry__ as entry
from glossagrid.operators import folds, tables, tokens
from glossagrid.plans import bindings as B
from glossagrid.plans.result_queries import METHODS

SF = "/root/testdata/sf0.001"
ROW_WISE = ["mcqa_reframe", "cloze_reframe", "chat_wrap", "label_encode", "tokenize_lengths", "parse_embedding_key", "script_of",
            "mask_filter", "score_mcqa", "confusion_matrix", "vocab_by_script", "length_stats", "flatten_config", "config_diff",
            "pool_folds", "lang_table", "calinski_harabasz", "validate_entries", "fold_split"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROW_WISE)
def test_built_in_expressions_only(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for word in ("BatchEvalPython", "ArrowEvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


@pytest.mark.parametrize("name", [n for n in sorted(entry.queries()) if n not in ("streaming_result_rollup", "pca_projection")])
def test_no_pair_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


@pytest.mark.parametrize("name", ["mcqa_reframe", "chat_wrap", "tokenize_lengths", "label_encode", "mask_filter"])
def test_row_wise_queries_do_not_group(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "Aggregate" not in text and "hashpartitioning" not in text


def test_flagship_reads_each_large_table_once_with_its_columns(spark):
    # With the methods given, nothing is computed ahead.
    text = plan(tables.lang_table(B.result_rows(spark, SF), seen=B.seen_langs(spark, SF), low=B.low_langs(spark, SF),
                                  zero_shot=B.zero_shot_rows(spark, SF), methods=METHODS, strict=False))
    assert text.count("lineitem.parquet") == 1 and text.count("orders.parquet") == 1
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_linenumber:int,l_returnflag:string,l_linestatus:string>" in text
    # Items are summed per supplier before the first join.
    lines = text.split("\n")
    scan = next(i for i, x in enumerate(lines) if "lineitem.parquet" in x)
    above = [x for x in lines[:scan] if len(x) - len(x.lstrip(" :+-")) < len(lines[scan])]
    assert any("HashAggregate" in x for x in above[-4:])


def test_language_filter_reaches_the_scan(spark):
    rows = folds.task_ids(B.table(spark, SF, "documents"), ["en", "fr"]).select("doc_id", "task_ids")
    text = plan(rows)
    assert "PushedFilters: [In(lang, [en,fr])]" in text and "ReadSchema: struct<doc_id:bigint,lang:string>" in text


def test_vocabulary_collapses_in_hash_aggregation(spark):
    text = plan(tokens.vocabulary_by_script(B.table(spark, SF, "documents"), tokens.pattern_tokenizer()))
    lines = [x.strip(" :+-*()0123456789") for x in text.split("\n")]
    generate = next(i for i, x in enumerate(lines) if x.startswith("Generate"))
    nearest = [x for x in lines[:generate] if "Aggregate" in x][-1]
    assert nearest.startswith("HashAggregate")
