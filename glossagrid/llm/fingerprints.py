"""Threshold-scaled sketches: all shingle hashes below a fixed fraction of the hash range.

The sketch of a union is the union of the sketches, so sketches merge, and the
share of one sketch found in another estimates containment even between very
unequal documents. A document whose hashes all lie above the threshold keeps its
smallest one. Shingles are five lower-case words; a shorter text is one shingle;
null, empty and blank texts have an empty sketch, which is like another empty one
(1) and unlike any other (0). Equal texts have equal sketches. Very long texts are
hashed whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .base import whole
from .sharding import locate

WORDS = 5
FRACTION = 1 / 8
ROWS_PER_BUCKET = 2000
MOST_BUCKETS = 20_000
LOWEST = -(1 << 63)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[^ \t-\r]+"), F.lit(0))


def sketch(words: Column, fraction: float = FRACTION, width: int = WORDS) -> Column:
    """Sorted distinct shingle hashes below the threshold; else the smallest."""
    limit = F.lit(LOWEST + int((1 << 64) * fraction))
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0)))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    low = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < limit)))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(
        F.size(low) > 0, low).otherwise(F.array(F.array_min(hashes)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles found in b; null for an empty a."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), ",")


def with_next(docs: DataFrame, carry: dict[str, Column]) -> DataFrame:
    """Each row with `next_<name>` of the row after it by descending doc_id; after the last the first.

    One shuffle of the rows: they are dealt into id ranges, and the head of each
    range also goes, as a sentinel, to the range before it. Rows with one id are
    ordered by their values; null ids come last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("key"),
                       F.col("doc_id").cast("bigint").alias("doc_id"), *[c.alias(n) for n, c in carry.items()])
    n = rows.select("key").count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(max(-(-n // ROWS_PER_BUCKET), 4 * parts), MOST_BUCKETS, n))
    at = F.lit([k / buckets for k in range(1, buckets)]).cast("array<double>")
    found = rows.agg(F.percentile_approx("key", at, 20 * buckets)).first()[0] if buckets > 1 else None
    bucket = locate(F.col("key"), sorted(set(found or [])))

    # One row per bucket: at most MOST_BUCKETS.
    heads = rows.select("key", bucket.alias("bucket")).groupBy("bucket").agg(F.max("key").alias("key"))
    order = Window.orderBy(F.col("bucket").desc())
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = settle(heads.select("key", F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(every)).alias("also")))

    marked = rows.join(F.broadcast(heads), "key", "left")
    places = F.array_compact(F.array(
        F.struct(bucket.alias("bucket"), F.lit(False).alias("extra")),
        F.when(F.col("also").isNotNull(), F.struct(F.col("also").alias("bucket"), F.lit(True).alias("extra")))))
    dealt = marked.select("key", "doc_id", *carry, F.explode(places).alias("p")).select("key", "doc_id", *carry, "p.*")
    follow = Window.partitionBy("bucket").orderBy("extra", F.col("key").desc(), F.xxhash64(*carry))
    nexts = [F.lead(c).over(follow).alias(f"next_{c}") for c in carry]
    return dealt.select("doc_id", *carry, "extra", *nexts).where(~F.col("extra")).drop("extra")


def fingerprint_edits(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Text, its edited text (the later half replaced by the start of the next document) and their sketches.

    Columns: doc_id, text, edited, sketch, edited_sketch, next_sketch.
    """
    text = whole(F.col("text"))
    rows = docs.select("doc_id", text.alias("text")).withColumn("words", words_of(F.col("text"))).select(
        "doc_id", "text", sketch(F.col("words"), fraction).alias("sketch"))
    paired = with_next(rows, {"text": F.col("text"), "sketch": F.col("sketch")})
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half),
                      F.substring(F.col("next_text"), F.lit(1), half))
    changed = paired.select("doc_id", "text", edited.alias("edited"), "sketch", "next_sketch")
    return changed.withColumn("words", words_of(F.col("edited"))).withColumn(
        "edited_sketch", sketch(F.col("words"), fraction)).drop("words")
