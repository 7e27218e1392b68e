"""Result rows that arrive run by run: keep the latest of each cell, pool on demand.

Spark's state store holds the latest row per (method, seed, fold, language); each
micro-batch hands on only the cells it changed. They are appended under the batch
id, and a batch that is run again overwrites its own folder, so the stored changes
are exactly-once. Reading takes the newest change per cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.tables import pool_folds

CELL = ("method", "seed", "fold", "target_lang")


def latest_cells(rows: DataFrame, order: Sequence[str] = ("time_id", "path")) -> DataFrame:
    """The last reported accuracy and item count of each cell (batch or stream)."""
    newest = F.max_by(F.struct("accuracy", "n", "llm", *order), F.struct(*order))
    return rows.groupBy(*CELL).agg(newest.alias("_r")).select(*CELL, "_r.*")


def watch_results(spark: SparkSession, landing: str, schema: T.StructType, *, files_per_batch: int = 1000) -> DataFrame:
    """Result files (Parquet, fixed schema) that land under a folder, as a stream."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option(
        "recursiveFileLookup", "true").parquet(landing)
    return stream.withColumn("path", F.col("_metadata.file_path"))


def start_rollup(rows: DataFrame, changes: str, checkpoint: str, **trigger):
    """Run the rollup; by default over everything that is there, then stop."""
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={batch_id}")

    return (
        latest_cells(rows).writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def current_cells(spark: SparkSession, changes: str, order: Sequence[str] = ("time_id", "path")) -> DataFrame:
    """The change of the latest run of each cell, whenever it was stored.

    Batch numbers only break ties: a late file of an older run, or a log started
    anew from `compact`, does not replace a newer run.
    """
    stored = spark.read.parquet(changes)
    fields = [c for c in stored.columns if c not in (*CELL, "batch")]
    newest = F.max_by(F.struct(*fields), F.struct(*order, "batch"))
    return stored.groupBy(*CELL).agg(newest.alias("_r")).select(*CELL, "_r.*")


def compact(spark: SparkSession, changes: str, target: str) -> None:
    """Current cells as one table, to start a new change log from."""
    current_cells(spark, changes).withColumn("batch", F.lit(-1)).write.mode("errorifexists").partitionBy("batch").parquet(target)


def rollup(spark: SparkSession, changes: str) -> DataFrame:
    """Pooled accuracy per (method, seed, language) from the current cells."""
    return pool_folds(current_cells(spark, changes))
