"""Labelled rows for training: bounded samples drawn by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .base import whole


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """At most `most` rows (doc_id, text, label) whose id satisfies `train`, settled.

    Null labels and ids are left out; a document with several labels takes the
    largest, and one with several rows the smallest text. Which rows are drawn depends on the ids alone.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    marked = marked.where(train)
    draw = F.xxhash64(F.lit("draw"), F.col("doc_id").cast("bigint"))
    # The labelled ids without a document are few; drawing among those with one needs the ids only.
    known = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    drawn = known.orderBy(draw, "doc_id").limit(most)
    rows = docs.select("doc_id", whole(F.col("text")).alias("text")).join(F.broadcast(settle(drawn)), "doc_id")
    return settle(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")))
