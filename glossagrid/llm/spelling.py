"""Spelling variants of frequent words, by an index of variable-length grams.

Words are maximal runs of ASCII and Latin-1 letters (A-Z lower-cased) with at least
6 characters and 5 occurrences. Two words are near if exactly one inserted,
deleted or replaced character parts them. A word's form is its near word with most
occurrences, if these are at least 5 times its own; following forms to the last gives
its root.

The gram dictionary holds grams of 2 to 4 characters of the padded words: a gram that
occurs more than `FREQUENT` times is too common and gives way to its extensions. At each
place of a word stands the shortest gram that is not too common, unless a gram further left
covers it. As this reads only the characters of the gram itself, one edit changes the grams
that hold the edited character, and at most those just right of it that a changed gram
could cover. The largest such number over all places is the word's bound: two near words
share all but that many grams of either, at places that the edit shifts together.
Lists are merged by it: ordered from rare to common, the rarest shared gram of two near words is
among the first (bound + 1) grams of both, so only these are indexed and only their
lists are met. The padding is so long that the bound is always below the number of
grams. Each pair that meets (same gram, places and lengths that one edit allows) passes a letter
mask and is then verified.

Null and empty texts have no words. A null id counts as empty text. Repeated rows count
each. Ties go to the smallest word in code-point order. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import lookup_side, settle

LETTERS = 6
OCCURRENCES = 5
RATIO = 5
DAMAGE = 199
GRAM = (2, 4)
FREQUENT = 50
FRONT, BACK = "<", ">"


def lowered(run: Column) -> Column:
    """A-Z as a-z; other letters as they are."""
    upper = "".join(map(chr, range(0x41, 0x5B)))
    return F.when(F.rlike(run, F.lit("[À-Þ]")), F.translate(run, upper, upper.lower())).otherwise(F.lower(run))


def damaged(run: Column, doc_id: Column, every: int) -> Column:
    """The lower-cased run, less one character where `every` divides the crc32 of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, every: int | None = DAMAGE) -> DataFrame:
    """(word, n) of the words long and frequent enough; `every` plants deletions, None takes texts as they are."""
    found = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{letters},}}"), F.lit(0))
    # Outer: an inner explode would become a filter below it and read the texts twice.
    runs = docs.select("doc_id", F.explode_outer(found).alias("run")).where("run IS NOT NULL")
    word = lowered(F.col("run"))
    if every:
        runs = runs.select("doc_id", word.alias("run"))
        word = damaged(F.col("run"), F.col("doc_id"), every)
    return runs.select(word.alias("word")).where(F.char_length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def _padded(word: Column) -> Column:
    pad = GRAM[1] - 1
    return F.concat(F.lit(FRONT * pad), word, F.lit(BACK * pad))


def common_grams(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(gram): those shorter than the longest that occur too often to be kept; with a gram also its beginnings."""
    each = words.select(_padded(F.col("word")).alias("padded")).select("padded", F.explode(F.sequence(F.lit(1), F.char_length("padded") - GRAM[0] + 1)).alias("p"))
    grams = each.select("padded", "p", F.explode(F.array(*[F.lit(k) for k in range(GRAM[0], GRAM[1])])).alias("width"))
    whole = grams.where(F.col("p") + F.col("width") - 1 <= F.char_length("padded"))
    return whole.select(F.substring("padded", F.col("p"), F.col("width")).alias("gram")).groupBy("gram").count().where(F.col("count") > frequent).select("gram")


def chosen_grams(ends: list[int]) -> list[tuple[int, int]]:
    """(place, end) of the grams that no gram further left covers."""
    out, covered = [], 0
    for p, end in enumerate(ends):
        if end > covered:
            out.append((p, end))
            covered = end
    return out


def affected_bound(grams: list[tuple[int, int]], size: int) -> int:
    """How many grams one edit of the padded word can change at most."""
    pad, most = GRAM[1] - 1, 0
    begins, last = [p for p, _ in grams], [e - 1 for _, e in grams]
    for i in range(pad, size - pad + 1):
        upto = max(bisect_right(begins, i), bisect_right(last, i + pad))
        most = max(most, upto - bisect_left(last, i))
    return most


_ELEMENTS = "word string, n bigint, mask bigint, gram string, p int, bound int"


def _decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pad = GRAM[1] - 1
    for batch in batches:
        out = [[] for _ in range(6)]
        for word, n, widths in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            padded = FRONT * pad + word + BACK * pad
            ends = [min(p + w, len(padded)) for p, w in enumerate(widths)]
            grams = chosen_grams(ends)
            bound, mask = affected_bound(grams, len(padded)), 0
            for c in word:
                mask |= 1 << (ord(c) & 63)
            mask -= (mask >> 63) << 64
            for p, end in grams:
                for column, value in zip(out, (word, n, mask, padded[p:end], p, bound)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()))],
                                         names=["word", "n", "mask", "gram", "p", "bound"])


def elements(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """word, n, mask, gram, p and bound for each gram of each word."""
    common = lookup_side(common_grams(words, frequent))
    each = words.select("word", "n", _padded(F.col("word")).alias("padded")).select(
        "word", "n", "padded", F.explode(F.sequence(F.lit(1), F.char_length("padded") - GRAM[0] + 1)).alias("p"))
    width = F.lit(GRAM[0])
    for k in range(GRAM[0], GRAM[1]):
        named = common.select(F.col("gram").alias(f"g{k}"))
        each = each.join(named, F.substring("padded", F.col("p"), F.lit(k)) == F.col(f"g{k}"), "left")
        # A gram that is common goes on; its beginnings are common too.
        width = width + F.col(f"g{k}").isNotNull().cast("int")
    placed = each.groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("p", width.alias("width")))).alias("held"))
    return placed.select("word", "n", F.col("held.width").alias("widths")).mapInArrow(_decompose, _ELEMENTS)


def near_pairs(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(a, na, b, nb): each pair of words (word, n) that one edit parts, once."""
    held = settle(elements(words, frequent))
    lists = lookup_side(held.groupBy("gram").agg(F.count("*").alias("held")))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("held", "gram", "p"))
    first = held.join(lists, "gram").withColumn("rank", rank).where(F.col("rank") <= F.col("bound") + 1)
    # The hash stands for gram, place and length; what it confuses, the verification parts again.
    first = settle(first.select("word", "n", "mask", F.char_length("word").alias("size"), "gram", "p"))
    key = lambda shift, longer: F.xxhash64("gram", F.col("p") + shift, F.col("size") + longer)
    index = first.select(key(0, 0).alias("key"), F.col("word").alias("b"), F.col("n").alias("nb"), F.col("mask").alias("mb"))
    # From each word to those of its length further on, and to those one character longer.
    probes = first.select(F.explode(F.array(*[F.struct(key(shift, longer).alias("key"), F.lit(longer == 0).alias("equal")) for shift, longer in ((0, 0), (0, 1), (1, 1))])).alias("at"),
                          F.col("word").alias("a"), F.col("n").alias("na"), F.col("mask").alias("ma")).select("at.*", "a", "na", "ma")
    near = (F.bit_count(F.col("ma").bitwiseXOR(F.col("mb"))) <= 2) & (~F.col("equal") | (F.col("a") < F.col("b")))
    met = probes.join(index, "key").where(near).where(F.levenshtein("a", "b", 1) == 1)
    return met.select("a", "na", "b", "nb").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed by doubling; counts grow along them, so they end."""
    now = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = settle(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not now.where("moved").head(1):
            return now.drop("moved")
        now = now.drop("moved")


def variants(words: DataFrame, frequent: int = FREQUENT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of (word, n)."""
    words = settle(words)
    pairs = settle(near_pairs(words, frequent))
    either = pairs.select("a", "na", "b", "nb").unionByName(pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    best = either.groupBy(F.col("a").alias("word"), F.col("na").alias("n")).agg(
        F.count("*").alias("n_near"), F.min(F.struct(F.negative("nb").alias("less"), F.col("b").alias("form"))).alias("best"))
    near = settle(best.select("word", "n_near", *[F.when(F.negative("best.less") >= ratio * F.col("n"), c).alias(name) for c, name in (
        (F.col("best.form"), "form"), (F.negative("best.less"), "form_n"))]))
    rooted = roots(near.where("form IS NOT NULL"))
    return words.join(near, "word", "left").join(rooted, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
