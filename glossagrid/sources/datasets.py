"""Datasets partitioned by lang / fold / split: write, verify, extend, list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions.checks import DataProblem, refuse
from ..functions.joins import match_keys
from ..operators.prompts import remap_splits
from ..session import lookup_side, settle

PARTS = ("lang", "fold", "split")


def write_partitioned(rows: DataFrame, path: str, parts: Sequence[str] = PARTS, *, mode: str = "overwrite",
                      rows_per_file: int = 1_000_000, observed: Observation | None = None) -> None:
    """One directory per partition value.

    Rows are rebalanced by partition value: Spark joins small ones in a task and
    cuts a hot one over several tasks and files by measured size. `observed` receives
    the rows handed to the writer; it sits behind the exchange, in the tasks that
    write, so a task that is run again counts once.
    """
    laid = rows.hint("rebalance", *parts)
    if observed is not None:
        laid = laid.observe(observed, *_sums(parts, F.lit(1)))
    laid.write.mode(mode).partitionBy(*parts).option(
        "maxRecordsPerFile", rows_per_file).parquet(path)


def partition_counts(rows: DataFrame, parts: Sequence[str] = PARTS) -> DataFrame:
    return rows.groupBy(*[F.col(p).cast("string").alias(p) for p in parts]).agg(F.count(F.lit(1)).alias("n_rows"))


def verify_written(rows: DataFrame, path: str, parts: Sequence[str] = PARTS) -> DataFrame:
    """Row counts per partition: expected, written, and whether they agree."""
    written = rows.sparkSession.read.parquet(path)
    expected = partition_counts(rows, parts).withColumnRenamed("n_rows", "n_expected")
    found = partition_counts(written, parts).withColumnRenamed("n_rows", "n_written")
    both = match_keys(expected, found, parts, "full_outer")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("n_expected", "n_written")}
    return both.withColumns(counts).withColumn("ok", F.col("n_expected") == F.col("n_written"))


def _sums(parts: Sequence[str], times: Column) -> list[Column]:
    """The number of rows and two sums of a hash of their partition, for rows that stand for `times` rows."""
    texts = [F.col(p).cast("string") for p in parts]
    hashes = [F.shiftright(F.xxhash64(F.lit(seed), *texts), 32).cast("decimal(20,0)") for seed in ("one", "two")]
    return [F.sum(h * times.cast("decimal(18,0)")).alias(n) for h, n in zip([F.lit(1).cast("decimal(20,0)"), *hashes], ("n", "one", "two"))]


def verify_observed(rows: DataFrame, path: str, observed: Observation, parts: Sequence[str] = PARTS) -> DataFrame:
    """The report of `verify_written` from sums observed while writing.

    Each row adds two hashes of its partition, so rows that are lost, doubled or in another
    partition change the sums; where they agree each partition holds what it should
    and the rows are not computed again. Only if they differ are they, to name the partition.
    """
    found = settle(partition_counts(rows.sparkSession.read.parquet(path), parts))
    written = found.agg(*_sums(parts, F.col("n_rows"))).first().asDict()
    if written != observed.get:
        return verify_written(rows, path, parts)
    return found.select(*parts, F.col("n_rows").alias("n_expected"), F.col("n_rows").alias("n_written"), F.lit(True).alias("ok"))


def write_verified(rows: DataFrame, path: str, parts: Sequence[str] = PARTS, strict: bool = True) -> DataFrame:
    """Write, read back and compare; returns the count report. The rows are computed once."""
    observed = Observation()
    write_partitioned(rows, path, parts, observed=observed)
    report = verify_observed(rows, path, observed, parts)
    if strict:
        refuse(report.where(~F.col("ok")), "partitions that did not round-trip")
    return report


def discover_partitions(spark: SparkSession, path: str, parts: Sequence[str] = PARTS) -> DataFrame:
    """Partition values that exist under a root, read from folder names alone; empty folders count."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        raise DataProblem(f"no dataset folder at {path}")
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    found = [(root, ())]
    # One listing per folder; a dataset has few of them beside its rows.
    for part in parts:
        below = []
        for folder, values in found:
            for status in store.listStatus(folder):
                name, _, value = status.getPath().getName().partition("=")
                if status.isDirectory() and name == part:
                    value = unescape(value)
                    below.append((status.getPath(), (*values, None if value == "__HIVE_DEFAULT_PARTITION__" else value)))
        found = below
    return spark.createDataFrame(sorted({v for _, v in found}, key=str), ", ".join(f"`{p}` string" for p in parts))


def saved_splits(partitions: DataFrame, tokenized: bool = False) -> DataFrame:
    """(lang, split) that were saved; tokenized copies, which name their `tokenizer`, only if asked for."""
    kept = partitions
    if "tokenizer" in partitions.columns and not tokenized:
        kept = kept.where(F.col("tokenizer").isNull())
    return kept.select("lang", "split").distinct()


def languages_with(partitions: DataFrame, *, exclude: Sequence[str] = (), **values) -> DataFrame:
    """Sorted languages that have the given sub-partition (e.g. fold=0)."""
    kept = partitions
    for name, value in values.items():
        kept = kept.where(F.col(name) == str(value))
    if exclude:
        kept = kept.where(~F.col("lang").isin(list(exclude)))
    return kept.select("lang").distinct().orderBy("lang")


def append_missing(rows: DataFrame, path: str, parts: Sequence[str] = PARTS) -> DataFrame:
    """Write only partitions that are not there yet; returns those written.

    A second call with the same rows writes nothing.
    """
    spark = rows.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    texts = {p: F.col(p).cast("string") for p in parts}
    fresh = rows.withColumns(texts)
    if there:
        fresh = match_keys(fresh, lookup_side(discover_partitions(spark, path, parts)), parts, "left_anti")
    # Few rows: the partition keys about to be written.
    new = fresh.groupBy(*parts).agg(F.count(F.lit(1)).alias("n_rows"))
    new = settle(new)
    if not new.isEmpty():
        write_partitioned(fresh, path, parts, mode="append")
    return new


def prepare_dataset(spark: SparkSession, path: str, lang: str, split_remap: Mapping[str, str] | None = None) -> DataFrame:
    """One language of a dataset, optionally with renamed splits."""
    rows = spark.read.parquet(path).where(F.col("lang") == lang)
    return rows if split_remap is None else remap_splits(rows, split_remap)


def manifest(rows: DataFrame, *, header: Mapping[str, str] = {}, lang: str = "lang", split: str = "split") -> DataFrame:
    """Per language its sorted list of {split, path, n_rows}, as JSON, under a header."""
    per_split = rows.groupBy(lang, split).agg(F.count(F.lit(1)).alias("n_rows"))
    entry = F.struct(
        F.col(split).alias("split"), F.concat(F.col(lang), F.lit("/"), F.col(split), F.lit("-*")).alias("path"), "n_rows")
    listed = per_split.groupBy(F.col(lang).alias("config_name")).agg(
        F.to_json(F.array_sort(F.collect_list(entry))).alias("data_files"))
    return listed.withColumns({k: F.lit(v) for k, v in header.items()})
