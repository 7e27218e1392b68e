"""Benchmark decontamination by template windows with a slot check.

Numbers, units after numbers and capitalised names within a sentence become typed
placeholders; the value stays with its placeholder as a slot. Windows of 8 template
tokens of every document are hash-joined with the windows of the benchmark items
(an item with fewer tokens is one window). Windows of one document and item on
the same diagonal form an occurrence. Its verbatim windows always count; windows with
changed slots count only if they are consistent: each value of the item always stands
for one value of the document, that of most windows.
An item leaks into a document if the windows that count cover at least half of its
windows. `changed` counts the slots whose values differ: 0 for plain copies, more
for re-parameterised questions.

Both sides are read in two ways, and an item counts by the way that covers more of it:
with placeholders for names (some in a row are one, with the first's value), and in lower case with
names as plain words, so that a change of case hides no copy. White space is one blank in
both. A text is split once. Every item window has an anchor, the rarest of its plain words (of its
tokens, if none is plain), and only windows around a token that is an anchor are hashed; of these only
such leave the text's row whose hash is in a bit set of the items' windows. So work grows with the
text's length. Which words are rare is told by the first `GUIDE` documents; that choice changes
the time taken and never the result.

Item windows with fewer than 3 plain words say too little and are left out. An item
with no other windows, mostly numbers, has exact windows instead: of its words and values, names as
plain words. Null
and empty texts leak nothing. Rows that share an id are one document. Null ids form
one document without id. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import match_keys
from ..session import BROADCAST_BYTES, lookup_side, settle
from .base import whole

WINDOW = 8
PLAIN = 3
COVER = 0.5
MARK, UNIT = "\x01", "\x02"
GUIDE = 2000
BITS = 1 << 20  # of each set of item hashes; more hashes only let more windows through to the join

# Units of measure that may follow a number.
UNITS = ["kilometres", "kilometers", "metres", "meters", "miles", "hours", "minutes", "seconds", "days", "weeks", "months", "years",
         "dollars", "euros", "cents", "percent", "grams", "kilograms", "litres", "liters",
         "km", "cm", "mm", "kg", "mg", "ml", "mph", "kwh", "m", "g", "l", "h", "s"]
NAMED, PLAINLY = 0, 1  # the two ways of reading
_HITS = "array<struct<way:int,wide:int,pos:int,hash:bigint,doc_slots:array<string>>>"


def _let(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column) -> Column:
    """Lower-case words; numbers are the mark, n and the value, names the mark, p and the word, units their mark and the unit.

    A name that goes on from the one before has q for p.
    """
    unit = "|".join(UNITS)
    out = F.regexp_replace(text, r"[\s\p{Z}]+", " ")
    out = F.regexp_replace(out, rf"(?=\p{{N}})(?<![\p{{L}}\p{{N}}])(\p{{N}}+(?:[.,:/]\p{{N}}+)*)(?:[- ]?((?i:{unit}))(?![\p{{L}}\p{{N}}]))?", f" {MARK}n$1 {UNIT}$2 ")
    out = F.regexp_replace(out, r"(?=\p{Lu})(?<=[\p{L}\p{N},;] )", f"{MARK}q")

    def headed(words: Column) -> Column:
        apart = lambda w: w.startswith(",") | w.startswith(";")
        name = lambda w: w.startswith(f"{MARK}q") | apart(w)
        head = lambda w, i: apart(w) | (i == 0) | ~name(F.get(words, i - 1))
        bare = lambda w: F.substring(w, F.when(apart(w), 5).otherwise(3), F.length(w))
        return F.transform(words, lambda w, i: F.when(~name(w), w).otherwise(F.concat(F.when(head(w, i), F.lit(f"{MARK}p")).otherwise(F.lit(f"{MARK}q")), bare(w))))

    def split(marked: Column) -> Column:
        found = F.regexp_extract_all(F.lower(marked), F.lit(rf"(?:[,;] )?{MARK}q[\p{{L}}\p{{N}}]+|{MARK}n\S+|{UNIT}\S+|[\p{{L}}\p{{N}}]+"), F.lit(0))
        # Texts without names need no second look.
        return F.when(F.contains(marked, F.lit(f"{MARK}q")), _let(found, headed)).otherwise(found)

    return _let(out, split)


def reading(words: Column, way: int) -> Column:
    """The tokens as one way reads them."""
    if way == NAMED:
        return F.filter(words, lambda w: ~w.startswith(f"{MARK}q"))
    return F.transform(words, lambda w: F.when(w.startswith(f"{MARK}p") | w.startswith(f"{MARK}q"), F.substring(w, F.lit(3), F.length(w))).otherwise(w))


def _marked(w: Column) -> Column:
    return w < "\x03"


def _shape(w: Column) -> Column:
    """A token's hash; a placeholder's is that of its type."""
    return F.xxhash64(F.when(_marked(w), F.when(w.startswith(UNIT), UNIT).otherwise(F.substring(w, 1, 2))).otherwise(w))


def slots(words: Column, at: Column, width: Column | int) -> Column:
    """Values of the placeholders of a window, in order."""
    marked = F.filter(F.slice(words, at + 1, width), _marked)
    return F.transform(marked, lambda w: F.substring(w, F.when(w.startswith(UNIT), 2).otherwise(3), F.length(w)))


def _plain(words: Column, at: Column, width) -> Column:
    return F.size(F.filter(F.slice(words, at + 1, width), lambda w: ~_marked(w)))


def window_hash(hashes: Column, at: Column, width: int, way: int) -> Column:
    """The hash of one window of token hashes."""
    return F.xxhash64(F.lit(width + 1000 * way), *[F.get(hashes, at + k) for k in range(width)])


def _telling_tokens(words: Column) -> Column:
    """(t, named): hashes of the plain tokens, or of all if none is plain, and of the same words in names."""
    plain = F.filter(words, lambda w: ~_marked(w))
    named = lambda w: F.array(*[F.xxhash64(F.concat(F.lit(MARK + kind), w)) for kind in "pq"])
    return F.transform(F.when(F.size(plain) > 0, plain).otherwise(words), lambda w: F.struct(F.xxhash64(w).alias("t"), named(w).alias("named")))


def anchors(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(anchor): of each window's tokens the one that the first documents have least."""
    first = docs.select("text").limit(GUIDE).select(F.explode(_let(tokens(whole(F.col("text"))), lambda w: reading(w, PLAINLY))).alias("w"))
    counts = first.groupBy(F.xxhash64("w").alias("t")).agg(F.count("*").alias("n"))
    each = windows.select("hash", F.explode("tokens").alias("x")).select("hash", "x.*").distinct()
    rare = F.min_by(F.struct("t", "named"), F.struct(F.coalesce("n", F.lit(0)), "t")).alias("a")
    chosen = each.join(F.broadcast(counts), "t", "left").groupBy("hash").agg(rare)
    return settle(chosen.select(F.explode(F.concat(F.array("a.t"), "a.named")).alias("anchor")).distinct())


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """hash, item_id, way, wpos, width, item_slots of every telling window; exact ones for items without any."""
    split = settle(benchmark.select("item_id", tokens(whole(F.col("text"))).alias("words")))
    read = [split.select("item_id", F.lit(way).alias("way"), reading(F.col("words"), way).alias("words")) for way in (NAMED, PLAINLY)]
    items = settle(read[0].unionByName(read[1]).where(F.size("words") > 0))
    wide = F.least(F.size("words"), F.lit(width))
    each = items.select("item_id", "way", "words", F.transform("words", _shape).alias("shapes"), F.transform("words", lambda w: F.xxhash64(w)).alias("values"),
                        wide.alias("width"), F.explode_outer(F.sequence(F.lit(0), F.size("words") - wide)).alias("wpos"))

    def hashed(of: str) -> Column:
        out = F.lit(None).cast("bigint")
        for way in (NAMED, PLAINLY):
            for w in range(1, width + 1):
                out = F.when((F.col("way") == way) & (F.col("width") == w), window_hash(F.col(of), F.col("wpos"), w, way)).otherwise(out)
        return out

    telling = _plain(F.col("words"), F.col("wpos"), F.col("width")) >= F.least(F.lit(PLAIN), F.col("width"))
    judged = settle(each.select(hashed("shapes").alias("hash"), hashed("values").alias("exact"), "item_id", "way", "wpos", "width", telling.alias("telling"),
                                _telling_tokens(F.slice("words", F.col("wpos") + 1, F.col("width"))).alias("tokens"), slots(F.col("words"), F.col("wpos"), F.col("width")).alias("item_slots")))
    columns = ["item_id", "way", "wpos", "width", "tokens", "item_slots"]
    mute = judged.where(F.col("way") == PLAINLY).groupBy("item_id").agg(F.max("telling").alias("any")).where(~F.col("any")).select(F.col("item_id").alias("mute"))
    exact = judged.where(F.col("way") == PLAINLY).join(mute, F.col("item_id").eqNullSafe(F.col("mute")), "left_semi")
    return judged.where("telling").select("hash", *columns).unionByName(exact.select(F.col("exact").alias("hash"), *columns))


def _consistent(held: Column) -> Column:
    """The windows (wpos, slots) that are verbatim, or whose slots agree with the value that most windows give each item value."""
    every = F.flatten(F.transform(held, lambda x: x["slots"]))
    pairs = F.array_distinct(every)
    steady = F.size(F.array_distinct(F.transform(pairs, lambda p: p["i"]))) == F.size(pairs)

    def chosen(p: Column, counted: Column) -> Column:
        """No other value of the document has more windows, or as many and goes before: unchanged, then the larger."""
        def rank(q):
            return F.struct(q["n"].alias("n"), (q["p"]["i"] == q["p"]["d"]).alias("same"), q["p"]["d"].alias("d"))

        return ~F.exists(counted, lambda q: (q["p"]["i"] == p["p"]["i"]) & (rank(q) > rank(p)))

    counted = F.transform(pairs, lambda p: F.struct(p.alias("p"), F.size(F.filter(every, lambda q: q == p)).alias("n")))
    kept = F.transform(F.filter(counted, lambda p: chosen(p, counted)), lambda p: p["p"])
    verbatim = lambda x: F.forall(x["slots"], lambda p: p["i"] == p["d"])
    return F.when(steady, held).otherwise(F.filter(held, lambda x: verbatim(x) | (F.size(F.array_except(x["slots"], kept)) == 0)))


def leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, width: int = WINDOW) -> DataFrame:
    """doc_id, item_id, matched, item_windows, coverage, changed for each leak."""
    listed = settle(item_windows(benchmark, width))
    totals = listed.groupBy("item_id", "way").agg(F.count("*").alias("item_windows"))
    size, widths = listed.agg(F.sum(48 + 16 * F.size("item_slots")), F.collect_set("width")).first()
    small = (size or 0) <= BROADCAST_BYTES

    def bit_set(held: DataFrame, name: str):
        """A test of hashes against a set; at most BITS / 64 rows are collected, and the literal is folded once."""
        word = lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(BITS // 64 - 1)).cast("int")
        known = {r.word: r.bits for r in held.groupBy(word(F.col(name)).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int({name} & 63))")).alias("bits")).collect()}
        bits = F.from_json(F.lit("[" + ",".join(str(known.get(k, 0)) for k in range(BITS // 64)) + "]"), "array<bigint>")
        return lambda h: F.getbit(F.get(bits, word(h)), h.bitwiseAND(F.lit(63)).cast("int")) == 1

    anchor, window = bit_set(anchors(listed, docs), "anchor"), bit_set(listed, "hash")

    def anchored(words: Column) -> Column:
        return F.filter(F.transform(F.transform(words, lambda w: F.xxhash64(w)), lambda h, j: F.when(anchor(h), j)), lambda j: j.isNotNull())

    def hits(read: Column) -> Column:
        """Of one reading (way, words, at). Every set is named once for all widths and ways, as each mention is a copy in the plan."""
        way, words, at = (read[x] for x in ("way", "words", "at"))

        def named(wide: int):
            def one(i: Column) -> Column:
                shapes = F.xxhash64(F.lit(wide) + 1000 * way, *[_shape(F.get(words, i + k)) for k in range(wide)])
                values = F.xxhash64(F.lit(wide) + 1000 * way, *[F.xxhash64(F.get(words, i + k)) for k in range(wide)])
                hashed = F.when((way == NAMED) | (_plain(words, i, wide) >= min(PLAIN, wide)), shapes).otherwise(values)
                return F.struct(F.lit(wide).alias("wide"), i.alias("pos"), hashed.alias("hash"))

            return one

        def around(wide: int) -> Column:
            last = F.size(words) - wide
            starts = F.filter(F.array_distinct(F.flatten(F.transform(at, lambda j: F.sequence(j - (wide - 1), j)))), lambda i: (i >= 0) & (i <= last))
            return F.transform(starts, named(wide))

        picked = F.filter(F.concat(*[around(w) for w in sorted(widths)]) if widths else F.array().cast("array<struct<wide:int,pos:int,hash:bigint>>"), lambda x: window(x["hash"]))
        return F.transform(picked, lambda x: F.struct(way.alias("way"), x["wide"].alias("wide"), x["pos"].alias("pos"), x["hash"].alias("hash"),
                                                      slots(words, x["pos"], x["wide"]).alias("doc_slots")))

    none = F.array().cast(_HITS)

    def matched(words: Column) -> Column:
        """An anchor of either way stands among the tokens, as a word of a name perhaps."""
        def pair(plain: Column, one: Column, at: Column, on: Column) -> Column:
            return F.array(*[F.struct(F.lit(way).alias("way"), held.alias("words"), places.alias("at")) for way, held, places in ((PLAINLY, plain, at), (NAMED, one, on))])

        def around(at: Column) -> Column:
            named = F.exists(words, lambda w: w.startswith(f"{MARK}p"))
            apart = _let(reading(words, NAMED), lambda x: pair(reading(words, PLAINLY), x, at, anchored(x)))
            found = F.flatten(F.transform(F.when(named, apart).otherwise(pair(words, words, at, at)), hits))
            return F.when(F.size(at) == 0, none).otherwise(F.concat(none, found))

        return _let(anchored(words), around)

    # Outer, as an inner explode would become a filter below it and read the texts twice. The hits are written on their own, so
    # that the sets are in the plan of one step without a shuffle; then only item windows that were hit need be broadcast.
    each = docs.select("doc_id", F.explode_outer(_let(tokens(whole(F.col("text"))), matched)).alias("h")).select("doc_id", "h.*")
    each = settle(each.where("hash IS NOT NULL"))
    own = listed.drop("tokens").withColumnRenamed("width", "wide")
    met = lookup_side(own.join(lookup_side(each.select("hash", "wide", "way").distinct(), 48), ["hash", "wide", "way"], "left_semi"))
    hit = each.join(met, ["hash", "wide", "way"]).select(
        "doc_id", "item_id", "way", "wpos", (F.col("pos") - F.col("wpos")).alias("diagonal"), "item_slots", "doc_slots")

    # Windows on one diagonal are at most those of the item, so these groups are small.
    zipped = F.arrays_zip(F.col("item_slots").alias("i"), F.col("doc_slots").alias("d"))
    found = hit.groupBy("doc_id", "item_id", "way", "diagonal").agg(F.collect_set(F.struct("wpos", zipped.alias("slots"))).alias("held"))
    held = found.select("doc_id", "item_id", "way", "diagonal", _consistent(F.col("held")).alias("held"))
    changed = F.size(F.array_distinct(F.flatten(F.transform("held", lambda x: F.filter(x["slots"], lambda p: p["i"] != p["d"])))))
    steady_only = held.select("doc_id", "item_id", "way", "diagonal", changed.alias("changed"), F.explode("held.wpos").alias("wpos"))
    counted = steady_only.groupBy("doc_id", "item_id", "way").agg(
        F.count_distinct("wpos").alias("matched"), F.min("changed").alias("changed"))
    share = F.col("matched") / F.col("item_windows")
    covered = counted.join(F.broadcast(totals) if small else totals, ["item_id", "way"]).select(
        "doc_id", "item_id", "way", "matched", "item_windows", share.alias("coverage"), F.col("changed").cast("bigint").alias("changed")).where(F.col("coverage") >= cover)
    best = F.max_by(F.struct("matched", "item_windows", "coverage", "changed"), F.struct("coverage", F.negative("changed"), F.negative("way")))
    return covered.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose document holds no benchmark item."""
    return match_keys(docs, leaks(docs, benchmark).select("doc_id").distinct(), ["doc_id"], "left_anti")
