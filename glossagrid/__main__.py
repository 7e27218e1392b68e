"""Command line: python -m glossagrid COMMAND ... (each writes a table and shows it).

  lang-table PATH            per-language table of one group of runs
  search-table PATH          validation table of a hyperparameter search
  target-source-table ROOT   target-by-source table over language tables
  reframe-mcqa SRC OUT       multiple-choice records (Parquet) to prompts
  reframe-cloze SRC OUT      cloze records to prompts with renamed splits
  label-topics SRC OUT       topic records to label ids
  tokenize SRC OUT           texts to tokens and lengths; finished partitions are skipped
  length-stats SRC OUT       token length statistics per language
  split-folds SRC OUT        prompts to item-disjoint folds
  wrap-chat SRC OUT          prompts to a chat layout; finished partitions are skipped
  cluster-quality SRC OUT    cluster metrics of an embedding store per layer
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from .constants import CHAT_LAYOUTS, CLOZE_SPLITS, FOLD_SEED, FOLD_SPLITS
from .functions import names as N
from .operators import bootstrap, folds, langsets, prompts, quality, tables, tokens, vectors
from .session import drop_scratch, settle
from .sources import datasets, embeddings, results


SHOWN = 20


def _csv(table: DataFrame, path: str, *order: str) -> DataFrame:
    """A result table, computed once: whole as CSV with a header, its first rows on the screen."""
    table = settle(table)
    ordered = table.orderBy(*order) if order else table
    ordered.write.mode("overwrite").option("header", "true").csv(path)
    print(path)
    ordered.show(SHOWN, truncate=False)
    return table


def _beside(path: str, report: str) -> str:
    return f"{path.removesuffix('.csv')}.{report}.csv"


def _groups(spark: SparkSession, path: str | None) -> DataFrame:
    groups = langsets.published_groups(spark)
    if path:
        extra = spark.read.schema("`group` string, lang string, ord int").option("header", "true").csv(path)
        groups = groups.unionByName(extra)
    return groups


def lang_table(spark, a) -> None:
    # Read from text once; the checks and the table then read columns.
    rows = settle(results.collect_results(spark, a.path, backbone=a.llm))
    zero_shot = None
    if a.zero_shot_path:
        zero_shot = results.collect_results(
            spark, a.zero_shot_path, backbone=a.llm, required=results.ZERO_SHOT_REQUIRED)
    seeds = [int(s) for s in a.seeds.split(",")] if a.seeds else None
    low = spark.read.schema("`group` string, lang string").option("header", "true").csv(a.low_groups) if a.low_groups else None
    table = tables.result_table(
        rows, _groups(spark, a.groups), low_groups=low, zero_shot=zero_shot, seeds=seeds, high_frac=a.high_frac,
        low_frac=a.low_frac, key=a.key, value=a.value)
    out = f"{a.out_prefix or a.path + '/lang_table'}.csv"
    table = _csv(table, out, table.columns[0])
    if "n_items" in table.columns:
        _csv(quality.incomplete_items(table), _beside(out, "incomplete_items"))


def search_table(spark, a) -> None:
    table = tables.search_table(
        results.collect_validation(spark, a.path), a.group_by, order=["path", "block", "line"])
    cell = ["method", "fold", *([a.group_by] if a.group_by else [])]
    out = a.out or f"{a.path}/lr_search_table.csv"
    table = _csv(table, out, *cell)
    _csv(quality.incomplete_seeds(table, cell), _beside(out, "incomplete_seeds"))
    if a.group_by:
        best = tables.best_by_group(table.withColumn(a.group_by, F.col(a.group_by).cast("double")), a.group_by)
        _csv(best, _beside(out, "best"))


def target_source_table(spark, a) -> None:
    groups = _groups(spark, a.groups)
    exclude = langsets.present(groups, a.exclude_group) if a.exclude_group else None
    label = {"joshi5": "j5", "": "excluded"}.get(a.exclude_group, a.exclude_group)
    scanned = settle(results.scan_tables(spark, a.root, grids=a.run_group, table=a.table_name))
    table = tables.target_source_table(
        scanned, flavour=a.target_groups, exclude=exclude, excluded=label, sizes=langsets.source_sizes(groups))
    out = a.out or f"{a.root}/{a.run_group[0]}.target_source_table.csv"
    table = _csv(table, out, "target_rank", "source_rank")
    if "zero_shot_acc" in table.columns:
        _csv(quality.baseline_spread(table), _beside(out, "baseline_spread"))


def reframe_mcqa(spark, a) -> None:
    rows = spark.read.parquet(a.src)
    keep = [c for c in ("lang", "split", "link", "question_number") if c in rows.columns]
    out = prompts.reframe_mcqa(rows, keep)
    parts = [c for c in ("lang", "split") if c in keep]
    _csv(prompts.bad_prompts(out), _beside(a.out, "rejected"))
    out = prompts.question_ids(out.where(F.col("text").isNotNull() & F.col("answer_label").isNotNull()), group=parts)
    _csv(datasets.write_verified(out, a.out, parts), _beside(a.out, "written"))


def reframe_cloze(spark, a) -> None:
    rows = spark.read.parquet(a.src)
    keep = [c for c in ("lang", "split") if c in rows.columns]
    out = prompts.reframe_cloze(rows, seed=a.seed, item=a.item, keep=keep)
    _csv(prompts.bad_prompts(out), _beside(a.out, "rejected"))
    out = out.where(F.col("text").isNotNull() & F.col("answer_label").isNotNull())
    if "split" in keep:
        out = prompts.remap_splits(out, CLOZE_SPLITS)
    _csv(datasets.write_verified(out, a.out, keep), _beside(a.out, "written"))


def label_topics(spark, a) -> None:
    rows = spark.read.parquet(a.src)
    parts = [c for c in ("lang", "split") if c in rows.columns]
    _csv(datasets.write_verified(prompts.label_topics(rows), a.out, parts), _beside(a.out, "written"))


def tokenize(spark, a) -> None:
    rows = tokens.tokenize(spark.read.parquet(a.src), tokens.pattern_tokenizer(a.pattern), text=a.text,
                           max_length=a.max_length, truncate=a.truncate)
    rows = rows.withColumn("tokenizer", F.lit(a.name))
    parts = [*[c for c in datasets.PARTS if c in rows.columns], "tokenizer"]
    _csv(datasets.append_missing(rows, a.out, parts), _beside(a.out, "written"))


def length_stats(spark, a) -> None:
    _csv(tokens.length_stats(spark.read.parquet(a.src), max_length=a.max_length), a.out, "lang")


def split_folds(spark, a) -> None:
    rows = spark.read.parquet(a.src).drop("split", "fold")
    report = folds.parallel_report(rows)
    _csv(report.where(~F.col("ok")), _beside(a.out, "not_parallel"))
    plan = folds.fold_plan(
        rows.join(report.where("ok").select("lang"), "lang", "left_semi"), n_splits=a.n_splits, train=a.train,
        val=a.val, test=a.test, seed=a.seed)
    _csv(datasets.write_verified(folds.fold_rows(folds.drop_unparallel(rows, report), plan), a.out), _beside(a.out, "written"))


def wrap_chat(spark, a) -> None:
    rows = spark.read.parquet(a.src)
    parts = [c for c in datasets.PARTS if c in rows.columns]
    _csv(datasets.append_missing(prompts.chat_wrap(rows, a.template), a.out, parts), _beside(a.out, "written"))


def cluster_quality(spark, a) -> None:
    key = F.col("key")
    label = N.lang_of_key(key)
    method = F.when(N.has_method(key, "xpe"), "xpe").when(N.has_method(key, "spt"), "spt")
    rows = embeddings.load_embeddings(spark, a.src).select(
        N.layer_of_key(key).alias("layer"), method.alias("method"),
        (N.script_of(label) if a.group_by == "script" else label).alias("cluster"),
        F.col("embedding").cast("array<double>").alias("embedding")).dropna(subset=["method"])
    # Numbered and written once, so that every step sees the same numbers.
    rows = settle(rows.withColumn("id", F.monotonically_increasing_id()))
    by = ["layer", "method"]
    quality_rows = vectors.cluster_quality(rows, by=by, cluster="cluster", id="id", sample=a.silhouette_sample)
    table = vectors.method_diff(quality_rows, by=["layer"])
    if a.n_resamples:
        metrics = bootstrap.replicate_metrics(rows, a.n_resamples, by=by, cluster="cluster", id="id")
        test = bootstrap.bootstrap_diff_test(metrics, quality_rows, by=["layer"])
        for m in ("db", "ch"):
            one = test.where(F.col("metric") == m).select(
                "layer", *[F.col(c).alias(f"diff_{m}_{c}") for c in ("ci_l", "ci_u", "se", "p")])
            table = table.join(one, "layer")
    _csv(table, a.out, "layer")


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="glossagrid", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = ap.add_subparsers(required=True)

    def command(name, run, *places):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for place in places:
            p.add_argument(place)
        return p

    p = command("lang-table", lang_table, "path")
    p.add_argument("--zero-shot-path")
    p.add_argument("--high-frac", type=float, default=0.5)
    p.add_argument("--low-frac", type=float, default=0.25)
    p.add_argument("--llm", help="backbone of rows that carry none")
    p.add_argument("--out-prefix")
    p.add_argument("--seeds", help="comma-separated seeds to keep")
    p.add_argument("--key", default="target_lang")
    p.add_argument("--value", default="accuracy")
    p.add_argument("--groups", help="CSV of further language groups: group, lang, ord")
    p.add_argument("--low-groups", help="CSV of low-performing languages: backbone, lang")
    p = command("search-table", search_table, "path")
    p.add_argument("--group-by", help="the swept column")
    p.add_argument("--out")
    p = command("target-source-table", target_source_table, "root")
    p.add_argument("--run-group", nargs="+", required=True)
    p.add_argument("--table-name", default="lang_table.csv")
    p.add_argument("--target-groups", default="auto", choices=["auto", "seen", "perf"])
    p.add_argument("--exclude-group", default="joshi5")
    p.add_argument("--groups")
    p.add_argument("--out")
    command("reframe-mcqa", reframe_mcqa, "src", "out")
    p = command("reframe-cloze", reframe_cloze, "src", "out")
    p.add_argument("--item", default="item", help="column that identifies a record over languages")
    p.add_argument("--seed", type=int, default=FOLD_SEED)
    command("label-topics", label_topics, "src", "out")
    p = command("tokenize", tokenize, "src", "out")
    p.add_argument("--text", default="text")
    p.add_argument("--pattern", default=r"\S+", help="what a token is")
    p.add_argument("--name", default="words", help="name of the tokenizer in the written partitions")
    p.add_argument("--max-length", type=int, default=1024)
    p.add_argument("--truncate", action="store_true")
    p = command("length-stats", length_stats, "src", "out")
    p.add_argument("--max-length", type=int, default=1024)
    p = command("split-folds", split_folds, "src", "out")
    p.add_argument("--n-splits", type=int, default=FOLD_SPLITS["n_splits"])
    for size in ("train", "val", "test"):
        p.add_argument(f"--{size}", type=int, default=FOLD_SPLITS[size])
    p.add_argument("--seed", type=int, default=FOLD_SEED)
    p = command("wrap-chat", wrap_chat, "src", "out")
    p.add_argument("--template", required=True, choices=sorted(CHAT_LAYOUTS))
    p = command("cluster-quality", cluster_quality, "src", "out")
    p.add_argument("--group-by", default="script", choices=["lang", "script"])
    p.add_argument("--silhouette-sample", type=int, help="0 skips, a number subsamples; default all rows")
    p.add_argument("--n-resamples", type=int, default=0)
    return ap


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        args.run(spark, args)
    finally:
        drop_scratch(spark)


if __name__ == "__main__":
    main()
