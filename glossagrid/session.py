"""Session helpers: the shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, functions as F, types as T

# Measured size up to which a lookup side may be broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024
# Rows of one task of heavy work.
SPREAD_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only where none is named (tests on one machine) a temporary folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="glossagrid-"))
    return context.getCheckpointDir()


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/glossagrid-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in this application's part of the shared folder."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's tables; call it when no result is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    Used where later steps read the same rows more than once, or must see exactly
    the same rows after an executor is lost. The table is columnar, so each step
    reads only its columns, and Spark knows its true size. Zstandard, as the default
    codec keeps direct buffers of every small file until the next collection.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value in memory: texts and arrays by their true lengths."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("bigint"), lambda a, x: a + _bytes(x, kind.elementType).cast("bigint")), F.lit(0)) + 24
        return F.coalesce(F.size(value), F.lit(0)) * 8 + 24
    if isinstance(kind, T.MapType):
        return _bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + _bytes(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def lookup_side(df: DataFrame, row_bytes: Column | int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A join side computed once and broadcast only if its measured size allows it.

    The size is summed over the values of all rows, unless `row_bytes` states that of
    a row. Beyond the limit the plain join is left to Spark, which shuffles both
    sides and splits skewed keys.
    """
    settled = settle(df)
    if row_bytes is None:
        row_bytes = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in settled.schema.fields), F.lit(32))
    row_bytes = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    size = settled.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(settled) if size <= limit else settled


def keyed(df: DataFrame, keys: Sequence[str]) -> GroupedData:
    """groupBy whose Python groups go over all shuffle partitions.

    Adaptive execution joins partitions by their bytes, but such groups are heavy
    by their computation.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).groupBy(*keys)


def spread(df: DataFrame) -> DataFrame:
    """Rows on all cores and in tasks of bounded length, for work that is heavy per row.

    The rows of each partition are counted, as the splits of a file may be empty or hold
    a large part of the rows each. Rows that already lie evenly pass through.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id()).count().agg(F.sum("count").alias("rows"), F.max("count").alias("most")).first()
    rows = held.rows or 0
    if not rows or held.most <= min(SPREAD_ROWS, -(-2 * rows // cores)):
        return df
    return df.repartition(max(cores, -(-rows // SPREAD_ROWS)))
