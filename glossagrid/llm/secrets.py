"""Secret scans: fixed patterns, and a randomness test battery on long unbroken tokens.

Patterns (assign, access, hex) give the base spans. Every other token of 20 or more
characters of the usual encodings is a candidate. Its encoding is inferred from
its characters (decimal, hex, base32, base36, base62, base64, base64url), and three
tests ask whether it looks drawn uniformly from that alphabet: chi-squared over
16 equal cells at most, runs above and below the middle of the alphabet, and lag-1
serial correlation. A candidate stays only if none of them rejects randomness
(Bonferroni over the three). Against ordinary text, whose characters
rarely change between lower case, upper case and digits, each candidate gets a
Chernoff bound as p-value; these are weighted by length and cut by
Benjamini-Hochberg over the whole table, which controls the share of false
discoveries. The p-values are binned on a fixed logarithmic grid, so the cut needs
only a bounded histogram.

Positions are code points, ends exclusive. Null and empty texts have no spans.
Every row is scanned by itself, so repeated rows give the same spans. An empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .base import whole

# The kinds of the base scan, in their order.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]
ASSIGNED_CHARS = 6

MARK = "\x01"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ACCEPT = 0.001
DISCOVERY = 0.01
SWITCHES = 0.05
BIN = 0.1
MOST_BINS = 4000

# Encodings from the smallest alphabet to the largest.
ENCODINGS = [
    ("[0-9]+", "0123456789"),
    ("[0-9a-f]+", "0123456789abcdef"),
    ("[0-9A-F]+", "0123456789ABCDEF"),
    ("[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("[0-9a-z]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("[0-9A-Za-z]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("[0-9A-Za-z+/]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("[0-9A-Za-z_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]


BLOCK = 64


def running(values: Column, join=lambda a, b: a + b) -> Column:
    """Running sums (or another `join`) of an array of longs: within blocks, then over the blocks' last values."""
    last = lambda x: F.get(x, F.size(x) - 1)
    longs = F.array().cast("array<bigint>")

    def grown(x: Column) -> Column:
        return F.aggregate(x, longs, lambda acc, v: F.concat(acc, F.array(F.when(F.size(acc) > 0, join(last(acc), v)).otherwise(v))))

    def joined(x: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))
        return _let(F.transform(at, lambda b: grown(F.slice(x, b * BLOCK + 1, BLOCK))), lambda blocks: _let(
            grown(F.transform(blocks, last)), lambda ends: F.flatten(F.transform(blocks, lambda block, i: F.when(i == 0, block).otherwise(
                F.transform(block, lambda v: join(F.get(ends, i - 1), v)))))))

    return _let(values, lambda x: F.when(F.size(x) > 0, joined(x)).otherwise(longs))


def matches(text: Column, pattern: str, keep=None) -> Column:
    """Places of the leftmost non-overlapping matches: array of (start, end, from, to, value); from and to in bytes.

    The text between matches and the matches themselves, in turn, add up to the
    positions. `keep` is the capture group that becomes the value.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(keep or 0))
    between = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:bigint,end:bigint,from:bigint,to:bigint,value:string>>")

    def placed(one: Column) -> Column:
        def ends(size) -> Column:
            return running(F.transform(one, lambda x: (size(x["gap"]) + size(x["found"])).cast("bigint")))

        both = F.struct(ends(F.char_length).alias("c"), ends(F.octet_length).alias("b"))
        return _let(both, lambda e: F.transform(one, lambda x, i: F.struct(
            (F.get(e["c"], i) - F.char_length(x["found"])).alias("start"), F.get(e["c"], i).alias("end"),
            (F.get(e["b"], i) - F.octet_length(x["found"])).alias("from"), F.get(e["b"], i).alias("to"), x["value"].alias("value"))))

    zipped = F.slice(F.arrays_zip(between.alias("gap"), found.alias("found"), value.alias("value")), F.lit(1), F.size(found))
    return F.when(F.rlike(text, F.lit(pattern)), _let(zipped, placed)).otherwise(empty)


def _spans(kind: int, places: Column) -> Column:
    return F.transform(places, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["from"].alias("from"), m["to"].alias("to")))


def base_spans(text: Column) -> Column:
    """Sorted array of (start, kind number, end, from, to) of the three patterns."""
    assigned = F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= ASSIGNED_CHARS)
    return F.array_sort(F.concat(_spans(0, assigned), _spans(1, matches(text, ACCESS)), _spans(2, matches(text, HEX))))


def covered(text: Column, spans: Column, cover) -> Column:
    """The text with spans (sorted by start) replaced; `cover` of a span and the end of those before it gives the replacement.

    Pieces are cut by byte positions and joined once, so time grows with the text and the spans.
    """
    def piece(x: Column) -> Column:
        def cut(a: Column, n: Column) -> Column:
            return F.substring(x["data"], (a + 1).cast("int"), n.cast("int")).cast("string")

        def joined(e: Column) -> Column:
            before = lambda field, i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(e[field], i - 1))
            parts = F.transform(x["spans"], lambda s, i: F.concat(
                cut(before("b", i), F.greatest(s["from"] - before("b", i), F.lit(0))), cover(s, before("c", i))))
            last = F.get(e["b"], F.size(e["b"]) - 1)
            return F.concat(F.array_join(parts, ""), cut(last, F.octet_length(x["data"]) - last))

        furthest = F.struct(
            running(F.transform(x["spans"], lambda s: s["end"]), F.greatest).alias("c"), running(F.transform(x["spans"], lambda s: s["to"]), F.greatest).alias("b"))
        return _let(furthest, joined)

    return F.when(F.size(spans) > 0, _let(F.struct(text.cast("binary").alias("data"), spans.alias("spans")), piece)).otherwise(text)


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (rational approximation, error below 2e-7)."""
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def _two_sided(z: Column) -> Column:
    return _erfc(F.abs(z) / math.sqrt(2))


def _upper(z: Column) -> Column:
    return F.when(z >= 0, _erfc(F.abs(z) / math.sqrt(2)) / 2).otherwise(1 - _erfc(F.abs(z) / math.sqrt(2)) / 2)


def _let(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _alphabet(body: Column) -> Column:
    """Letters of the smallest encoding that has all characters; null for none."""
    found = F.lit(None).cast("string")
    for pattern, letters in reversed(ENCODINGS):
        found = F.when(F.rlike(body, F.lit(f"^{pattern}$")), F.lit(letters)).otherwise(found)
    return found


def _steps(n: Column) -> Column:
    return F.sequence(F.lit(1), n.cast("int") - 1)


def _p_uniform(codes: Column, n: Column, size: Column) -> Column:
    """Chi-squared over at most 16 cells; where these are uneven, by their exact shares."""
    cells = F.least(size, F.lit(16.0))

    def test(cell: Column) -> Column:
        def term(k: Column) -> Column:
            expected = n * (F.ceil((k + 1) * size / cells) - F.ceil(k * size / cells)) / size
            return _let(F.struct(F.size(F.filter(cell, lambda x: x == k)).cast("double").alias("o"), expected.cast("double").alias("e")),
                        lambda v: (v["o"] - v["e"]) * (v["o"] - v["e"]) / v["e"])

        chi = F.aggregate(F.transform(F.sequence(F.lit(0), cells.cast("int") - 1), term), F.lit(0.0), lambda a, x: a + x)
        df = cells - 1
        return _upper((F.pow(chi / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))

    return _let(F.transform(codes, lambda x: F.floor(x * cells / size)), test)


def _p_runs(codes: Column, n: Column, size: Column) -> Column:
    """Number of runs above and below the middle of the alphabet."""
    def test(high: Column) -> Column:
        ones = F.aggregate(high, F.lit(0), lambda a, x: a + x).cast("double")
        turns = F.aggregate(_steps(n), F.lit(0), lambda a, i: a + F.abs(F.get(high, i) - F.get(high, i - 1))).cast("double")
        return _let(F.struct((2 * ones * (n - ones)).alias("p"), turns.alias("t")), lambda v: F.when(
            v["p"] > n, _two_sided((v["t"] - v["p"] / n) / F.sqrt(v["p"] * (v["p"] - n) / (n * n * (n - 1))))).otherwise(0.0))

    return _let(F.transform(codes, lambda x: (x * 2 >= size).cast("int")), test)


def _p_serial(codes: Column, n: Column, size: Column) -> Column:
    """Correlation of each character's place in the alphabet with the one before."""
    mean = (size - 1) / 2
    lagged = F.aggregate(_steps(n), F.lit(0.0), lambda a, i: a + (F.get(codes, i) - mean) * (F.get(codes, i - 1) - mean))
    return _two_sided(lagged / ((size * size - 1) / 12 * F.sqrt(n - 1)))


def _p_text(body: Column, n: Column) -> Column:
    """Chernoff bound on so many changes between lower case, upper case and digits in ordinary text."""
    kind = F.transform(F.split(body, ""), lambda c: F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3))
    changes = _let(kind, lambda k: F.aggregate(_steps(n), F.lit(0), lambda a, i: a + (
        (F.get(k, i) != F.get(k, i - 1)) & (F.get(k, i) < 3) & (F.get(k, i - 1) < 3)).cast("int")))

    def bound(rate: Column) -> Column:
        left = F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - SWITCHES))).otherwise(0.0)
        return F.when(rate > SWITCHES, F.exp(-(n - 1) * (rate * F.log(rate / SWITCHES) + left))).otherwise(1.0)

    return _let(changes / (n - 1), bound)


def battery(token: Column) -> Column:
    """(p_random, p_text, n) of a token: consistency with random, and with ordinary text."""
    def judge(t: Column) -> Column:
        codes = F.transform(F.split(t["body"], ""), lambda c: F.instr(t["letters"], c).cast("double") - 1)
        size, n = F.length(t["letters"]).cast("double"), t["n"]
        p_random = _let(codes, lambda x: F.least(F.lit(1.0), 3 * F.least(_p_uniform(x, n, size), _p_runs(x, n, size), _p_serial(x, n, size))))
        tested = t["letters"].isNotNull() & (n >= 16)
        return F.struct(F.when(tested, p_random).otherwise(0.0).alias("p_random"),
                        F.when(tested, _p_text(t["body"], n)).otherwise(1.0).alias("p_text"), n.cast("int").alias("n"))

    def parts(body: Column) -> Column:
        return F.struct(body.alias("body"), _alphabet(body).alias("letters"), F.length(body).cast("double").alias("n"))

    return _let(_let(F.rtrim(token, F.lit("=")), parts), judge)


def candidates(text: Column, base: Column) -> Column:
    """Tested tokens outside all base spans: array of (start, end, p_random, bin).

    The bin is the weighted p-value on a logarithmic grid, larger for smaller p; a
    weight of n/32 trusts long tokens more than short ones.
    """
    # Base spans become marks of the same length, ASCII as they are; a token that holds a mark meets one. Texts with such marks
    # of their own are compared span by span.
    masked = covered(text, base, lambda s, before: F.repeat(F.lit(MARK), F.greatest(s["end"] - F.greatest(s["start"], before), F.lit(0)).cast("int")))
    marked = F.filter(matches(masked, CANDIDATE.replace("[", f"[{MARK}")), lambda m: ~F.contains(m["value"], F.lit(MARK)))
    apart = F.filter(matches(text, CANDIDATE), lambda m: ~F.exists(base, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    free = F.when(F.size(base) == 0, matches(text, CANDIDATE)).when(F.contains(text, F.lit(MARK)), apart).otherwise(marked)
    place = lambda m: [m[c].alias(c) for c in ("start", "end", "from", "to")]
    tested = F.transform(free, lambda m: F.struct(*place(m), battery(m["value"]).alias("p")))
    return F.transform(tested, lambda m: F.struct(
        *place(m), m["p"]["p_random"].alias("p_random"),
        F.greatest(F.lit(0), F.least(F.lit(MOST_BINS), F.floor(-F.log10(F.greatest(m["p"]["p_text"], F.lit(1e-300)) * 32 / m["p"]["n"]) / BIN))).cast("int").alias("bin")))


def scan(docs: DataFrame) -> DataFrame:
    """The rows with `base` spans and tested `candidates`, before the false-discovery cut."""
    def without_bytes(column: str, fields: list[str]) -> Column:
        return F.transform(column, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(column)

    placed = _placed(docs)
    return placed.withColumns({c: without_bytes(c, f) for c, f in (("base", ["start", "kind", "end"]), ("candidates", ["start", "end", "p_random", "bin"]))})


def _placed(docs: DataFrame) -> DataFrame:
    """Like `scan`; all places also in bytes."""
    kept = docs.select(*[c for c in docs.columns if c not in ("base", "candidates")])
    based = kept.withColumn("base", base_spans(whole(F.col("text"))))
    return based.withColumn("candidates", candidates(whole(F.col("text")), F.col("base")))


def discovery_bin(scanned: DataFrame) -> int:
    """Lowest bin that passes Benjamini-Hochberg over all candidates of the table."""
    # An inner explode would be turned into a filter below it and scan the texts twice.
    each = scanned.select(F.explode_outer("candidates").alias("c")).where("c IS NOT NULL")
    # At most MOST_BINS + 1 rows.
    counts = {r.bin: (r.n, r.m) for r in each.groupBy("c.bin").agg(
        F.count_if(F.col("c.p_random") >= ACCEPT).alias("n"), F.count("*").alias("m")).collect()}
    tests, passed, cut = sum(m for _, m in counts.values()), 0, MOST_BINS + 1
    for b in sorted(counts, reverse=True):
        passed += counts[b][0]
        if 10 ** (-b * BIN) <= DISCOVERY * passed / tests:
            cut = b
    return cut


def with_spans(scanned: DataFrame, cut: int) -> DataFrame:
    """`spans`: base spans and discovered ones, sorted by start and kind."""
    fields = [f.name for f in scanned.schema["base"].dataType.elementType.fields]
    found = F.transform(F.filter("candidates", lambda c: (c["bin"] >= cut) & (c["p_random"] >= ACCEPT)),
                        lambda c: F.struct(*[F.lit(3).alias(f) if f == "kind" else c[f].alias(f) for f in fields]))
    return scanned.withColumn("spans", F.array_sort(F.concat("base", found))).drop("candidates")


def span_text(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns; every found span, overlapping ones together, becomes the mask.

    The caller's columns travel as one, so that none is taken for the scan's.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    scanned = settle(_placed(rows))
    found = with_spans(scanned, discovery_bin(scanned))
    masked = covered(F.col("text"), F.col("spans"), lambda s, before: F.when(s["start"] < before, F.lit("")).otherwise(F.lit(mask)))
    clean = found.select("row", masked.alias("text"))
    return clean.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
