"""Embedding stores: rows of (key, embedding)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import lookup_side


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("key", "embedding")


def key_counts(store: DataFrame) -> DataFrame:
    """Rows and vector width per key."""
    return store.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("embedding")).alias("width"))


def merge_shards(first: DataFrame, second: DataFrame, *, key: str = "key", row: str = "row_id") -> DataFrame:
    """Two stores key by key.

    `key_order` counts the keys of the first store (by name), then the new ones of
    the second; inside a key, rows of shard 1 come before those of shard 2.
    """
    from pyspark.sql import Window as W

    both = first.withColumn("shard", F.lit(1)).unionByName(second.withColumn("shard", F.lit(2)))
    # A store has few keys beside its rows.
    keys = both.groupBy(key).agg(F.min("shard").alias("_first"))
    order = keys.select(key, (F.row_number().over(W.orderBy("_first", key)) - 1).alias("key_order"))
    return both.join(lookup_side(order), key)


def select_embeddings(store: DataFrame, *, labels: Sequence[str] | DataFrame | None = None, model: str | None = None,
                      group: str | None = None, layers: Sequence[str] = (), key: str = "key") -> DataFrame:
    """Rows of the listed keys, or of keys naming model, group and any of the layers."""
    if labels is not None:
        if isinstance(labels, DataFrame):
            return store.join(labels.select(key), key, "left_semi")
        return store.where(F.col(key).isin(list(labels)))
    if model and group and layers:
        any_layer = F.lit(False)
        for layer in layers:
            any_layer = any_layer | F.col(key).contains(layer)
        return store.where(F.col(key).contains(model) & F.col(key).contains(group) & any_layer)
    return store
