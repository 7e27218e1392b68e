"""Hierarchical Pitman-Yor language model over words and their predecessors.

Every word has a context restaurant for what follows it; all of them share one
parent restaurant, whose base is uniform over the known words and one unknown.
Customers are the training tokens; a table of a context is a customer of the
parent. Chinese-restaurant seatings are sampled by Gibbs: in each sweep all customers of a
dish leave and sit down again, given the other dishes. The probabilities are averaged over
the kept samples: they are linear in the numbers of tables, so the averages of these enter.

Contexts are dealt into buckets by a hash, so a restaurant is wholly in one bucket and
can be sampled there; contexts found to be frequent in a bounded sample are
split over all buckets, and only their totals are exchanged. While contexts are
sampled, the parent is estimated from the bucket's own dishes; the parent
itself is seated from the tables of all contexts. Discount and strength of the contexts
are those that predict a bucket's own tokens best when each is left out. The
seating depends on the bucket's counts only, so a second pass seats alike.

Tokens: words between ASCII blanks, ASCII letters lower-cased, and one end per text. Null
and empty texts are just the end. Rows without id are held out like id "". Repeated rows
count as often as they occur and score alike. Without training rows the model is
the uniform base. An empty table gives no rows.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .base import WordHashes

START, END = np.uint64(0), np.uint64(1)
HASH = np.uint64((1 << 56) - 1)
BUCKET_BYTES = 13_000_000
LEAST_BUCKETS = 64
SAMPLE_ROWS = 2000
MOST_WORD_BITS = 20
BURN, SAMPLES, THIN = 6, 3, 2
LARGE = 512  # customers up to which the ways of seating are counted one by one
NIL = 1e-9
TOP_DISCOUNT, TOP_STRENGTH = 0.6, 10.0
DISCOUNTS, STRENGTHS = (0.3, 0.5, 0.7, 0.85, 0.95), (0.1, 1.0, 10.0, 100.0)


def pack(arrays: list[np.ndarray]) -> bytes:
    import zstandard

    head = struct.pack("<H", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at = struct.unpack_from("<H", raw)[0], 2
    kinds = []
    for _ in range(n):
        kinds.append(struct.unpack_from("<2sQ", raw, at))
        at += 10
    out = []
    for kind, length in kinds:
        out.append(np.frombuffer(raw, "<" + kind.decode(), length, at))
        at += out[-1].nbytes
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def hash_bytes(h: np.ndarray) -> np.ndarray:
    """Sorted 56-bit hashes, byte plane by byte plane."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].T).ravel()


def bytes_hash(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 7, 8), np.uint8)
    out[:, :7] = b.reshape(7, -1).T
    return out.view("<u8").ravel()


def bucket_of(u: np.ndarray, w: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    mixed = np.where(np.isin(u, hot), (u ^ (w * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(5), u)
    return ((mixed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)) % np.uint64(n)


def widths(n: int) -> tuple[int, int]:
    """Bits for words and for rows of a run, so that bucket, context, word and row fit into one 64-bit key."""
    word = next(t for t in range(MOST_WORD_BITS, 7, -1) if n <= 1 << (64 - 2 * t - (t - 6)))
    return word, word - 6


def runs(ids: list, texts: list, trained: list, before: int, hashes, word_bits: int, row_bits: int) -> Iterator[tuple]:
    """Runs of pieces of documents: (id, trained, number of the row), predecessor of each piece, its tokens.

    A run has fewer than 2**word_bits tokens and starts, and at most 2**row_bits pieces; longer documents are cut.
    """
    most = (1 << word_bits) // 2
    rows, starts, held, size = [], [], [], 0
    for k, (doc_id, text, flag) in enumerate(zip(ids, texts, trained)):
        tokens = np.append(hashes.of(text) & HASH, END)
        for at in range(0, len(tokens), most):
            piece = tokens[at:at + most]
            if held and (size + len(piece) > most or len(rows) == 1 << row_bits):
                yield rows, starts, held
                rows, starts, held, size = [], [], [], 0
            rows.append((doc_id, flag, before + k))
            starts.append(tokens[at - 1] if at else START)
            held.append(piece)
            size += len(piece)
    if held:
        yield rows, starts, held


def blobs(docs: DataFrame, train: Column, hot: np.ndarray, n: int, with_rows: bool) -> DataFrame:
    """One row per run and bucket: its (u, w) with training counts, or every (u, w, row), packed."""
    word_bits, row_bits = widths(n)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part, before = WordHashes(), TaskContext.get().partitionId(), 0
        word, low = np.uint64(word_bits), np.uint64(row_bits if with_rows else 1)
        mask = np.uint64((1 << word_bits) - 1)
        for batch in batches:
            for rows, starts, held in runs(*[batch.column(k).to_pylist() for k in range(3)], before, hashes, word_bits, row_bits):
                sizes = np.array([len(h) for h in held])
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                words, index = np.unique(np.concatenate([np.array(starts, np.uint64), *held]), return_inverse=True)
                index = index.astype(np.uint64)
                wi = index[len(starts):]
                ui = np.empty_like(wi)
                ui[1:] = wi[:-1]
                ui[first] = index[:len(starts)]
                bucket = bucket_of(words, words, np.zeros(0, np.uint64), n)[ui]
                split = np.flatnonzero(np.isin(words, hot)[ui])
                bucket[split] = bucket_of(words[ui[split]], words[wi[split]], hot, n)
                tail = np.repeat(np.arange(len(held)) if with_rows else np.array([r[1] for r in rows]), sizes).astype(np.uint64)
                key = np.sort((((bucket << word | ui) << word | wi) << low) | tail)
                ends = np.append(np.searchsorted(key, np.arange(n, dtype=np.uint64) << (word * np.uint64(2) + low)), len(key))
                own = np.array([-1 if r[0] is None else r[0] for r in rows], np.int64)
                known, flags = np.array([r[0] is not None for r in rows], np.uint8), np.array([r[1] for r in rows], np.uint8)
                numbers = np.array([r[2] for r in rows], np.int64)
                out = ([], [])
                for b in np.flatnonzero(np.diff(ends)).tolist():
                    k = key[ends[b]:ends[b + 1]]
                    pair = k >> low
                    if not with_rows:
                        begin = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                        count = np.add.reduceat((k & np.uint64(1)).astype(np.int64), begin)
                        pair = pair[begin]
                    x, y = ((pair >> word) & mask).astype(np.int64), (pair & mask).astype(np.int64)
                    used = np.unique(np.concatenate([x, y]))
                    begin = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                    arrays = [hash_bytes(words[used]), narrow(np.searchsorted(used, x[begin])),
                              narrow(np.diff(np.append(begin, len(x)))), narrow(np.searchsorted(used, y))]
                    if with_rows:
                        seen, local = np.unique((k & np.uint64((1 << row_bits) - 1)).astype(np.int64), return_inverse=True)
                        arrays += [narrow(local), own[seen], known[seen], flags[seen], numbers[seen]]
                    else:
                        arrays.append(narrow(count))
                    out[0].append(b)
                    out[1].append(pack(arrays))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array([part] * len(out[0]), pa.int32()), pa.array(out[1], pa.binary())],
                                                 names=["bucket", "part", "blob"])
            before += batch.num_rows

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), train.alias("train"))
    return rows.mapInArrow(deal, "bucket int, part int, blob binary")


def gather(packed: list[bytes], with_rows: bool):
    """The bucket's words (sorted), and of its entries u, w (places in words) and count, or the row and all rows."""
    parts = [unpack(p) for p in packed]
    words = np.unique(np.concatenate([bytes_hash(p[0]) for p in parts]))
    u, w, last, base = [], [], [], 0
    rows = [[], [], [], []]
    for p in parts:
        to = np.searchsorted(words, bytes_hash(p[0])).astype(np.int32)
        u.append(np.repeat(to[p[1]], p[2]))
        w.append(to[p[3]])
        last.append(p[4].astype(np.int32) + base)
        if with_rows:
            base += len(p[5])
            for held, own in zip(rows, p[5:]):
                held.append(own)
    sizes = [len(p[5]) for p in parts] if with_rows else None
    del parts
    out = words, np.concatenate(u), np.concatenate(w), np.concatenate(last)
    return (*out, [np.concatenate(r) for r in rows], sizes) if with_rows else out


def dishes(u, w, count, n: int):
    """Sorted distinct (u, w) with summed counts, and the place of each entry among them."""
    key = (u.astype(np.int64) << 32) | w
    order = np.argsort(key, kind="stable")  # made of sorted runs
    key = key[order]
    fresh = np.append(True, key[1:] != key[:-1])
    begin = np.flatnonzero(fresh)
    c = np.add.reduceat(count[order].astype(np.int64), begin)
    place = np.empty(len(key), np.int32)
    place[order] = np.cumsum(fresh, dtype=np.int32) - 1
    key = key[begin]
    return (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), c, place


def fitted(u, c, p1, cu, tu) -> tuple[float, float]:
    """Discount and strength with the best leave-one-out likelihood of all counts.

    A context's only customer is predicted by the parent at any discount, so such dishes are left out.
    """
    best = (-math.inf, 0.7, 1.0)
    pick = np.flatnonzero((c > 0) & (cu[u] > 1))
    if not len(pick):
        return best[1:]
    n, of, p = c[pick].astype(np.float32), cu[u[pick]], p1[pick].astype(np.float32)
    t = (tu[u[pick]] - (n == 1)).astype(np.float32)
    rest = n - np.float32(1)
    contexts = np.flatnonzero(cu > 1)
    for s in STRENGTHS:
        under = float(cu[contexts] @ np.log(s + cu[contexts] - 1))
        for d in DISCOUNTS:
            q = np.maximum(rest - np.float32(d), 0) + (np.float32(s) + np.float32(d) * t) * p
            value = float(np.sum(n * np.log(q), dtype=np.float64)) - under
            best = max(best, (value, d, s))
    return best[1:]


class Seatings:
    """How the number of ways to seat n customers changes from k tables to k + 1, at one discount.

    Exact from the recursion S(n + 1, k) = S(n, k - 1) + (n - d k) S(n, k) below LARGE
    customers. Beyond, S(n, k) (k - 1)! d^(k - 1) / S(n, 1) depends on (k - 1) / n^d only, up to terms
    that vanish with n, so it is read from the last exact row.
    """

    def __init__(self, d: float):
        self.d, k = d, np.arange(LARGE + 2)
        row = np.full(LARGE + 2, -np.inf)
        row[1] = 0.0
        self.grow = np.zeros((LARGE + 1, LARGE + 1))
        for n in range(1, LARGE + 1):
            ways = row[1:n + 1]
            self.grow[n, 1:n] = np.exp(np.diff(ways))
            stay = row + np.log(np.maximum(n - k * d, 1e-300))
            stay[n + 1:] = -np.inf
            if n < LARGE:
                row = np.logaddexp(np.concatenate([[-np.inf], row[:-1]]), stay)
        self.at = np.arange(LARGE)
        self.shape = row[1:LARGE + 1] - row[1] + np.cumsum(np.log(np.maximum(self.at * d, d) * (self.at > 0) + (self.at == 0)))

    def ratio(self, n: np.ndarray, k: int) -> np.ndarray:
        few = n <= LARGE
        out = np.zeros(len(n))
        if k <= LARGE:
            out[few] = self.grow[n[few], k]
        if not few.all():
            share = (n[~few] / LARGE) ** -self.d
            grown = np.interp(k * share, self.at, self.shape) - np.interp((k - 1) * share, self.at, self.shape)
            out[~few] = np.where(k * share < LARGE - 1, np.exp(grown) / (self.d * k), 0.0)
        return out

    def draw(self, n, p, others, s: float, rng) -> np.ndarray:
        """Table numbers of dishes of n customers each, given the tables of the others in the restaurant.

        The weights of 1, 2, ... tables are gone through once; each is taken with its share of the
        weights so far, until what follows has a share below NIL.
        """
        k, live, at = np.ones(len(n), np.int64), np.arange(len(n)), 1
        share = np.ones(len(n))
        while len(live):
            weight = share * (s + self.d * (others + at)) * p * self.ratio(n, at)
            share, at = weight / (1 + weight), at + 1
            k[live[rng.random(len(live)) < share]] = at
            on = (share > NIL) & (n > at)
            live, share, n, p, others = live[on], share[on], n[on], p[on], others[on]
        return k


def seat(group, c, p1, groups: int, d: float, s: float, scale: np.ndarray, rng, steps=(BURN, SAMPLES, THIN)):
    """Tables per dish: the mean over the kept samples, and the last sample.

    `group` is the restaurant of each dish; `scale` multiplies the tables of a restaurant of
    which only a share is here. In a sweep all customers of every other dish leave and sit down
    again given the rest of the restaurant, then those of the dishes between. Who shares a table
    with whom within a dish never enters a probability, so only the number of tables is drawn,
    from its exact conditional, whatever the count.
    """
    many = np.flatnonzero(c > 1)
    tables = (c > 0).astype(np.int64)
    averaged = tables.astype(float)
    if not len(many):
        return averaged, tables
    averaged[many] = 0.0
    ways = Seatings(d)
    total = np.bincount(group, tables, groups)
    halves = [(at, group[at], c[at], p1[at]) for at in (many[::2], many[1::2])]
    for step in range(steps[0] + steps[1] * steps[2]):
        for at, of, n, p in halves:
            others = np.maximum(total[of] * scale[of] - tables[at], 0)
            drawn = ways.draw(n, p, others, s, rng)
            total += np.bincount(of, drawn - tables[at], groups)
            tables[at] = drawn
        if step >= steps[0] and (step - steps[0]) % steps[2] == steps[2] - 1:
            averaged[many] += tables[many] / steps[1]
    return averaged, tables


class Bucket:
    """Counts and sampled seating of a bucket's contexts."""

    def __init__(self, words, u, w, count, hot: np.ndarray, n: int, bucket: int):
        self.u, self.w, self.c, self.place = dishes(u, w, count, len(words))
        size = len(words)
        self.cu = np.bincount(self.u, self.c, size)
        types = np.bincount(self.w, self.c > 0, size)
        p1 = ((types + 0.1) / (types.sum() + 0.1 * size))[self.w]
        tu = np.bincount(self.u, self.c > 0, size)
        self.d, self.s = fitted(self.u, self.c, p1, self.cu, tu)
        self.is_hot = np.isin(words, hot)
        scale = np.where(self.is_hot, float(n), 1.0)
        rng = np.random.default_rng([11, bucket])
        self.t, self.last = seat(self.u, self.c, p1, size, self.d, self.s, scale, rng)
        self.tu = np.bincount(self.u, self.t, size)
        self.asked = np.unique(self.w)

    def predict(self, p1: np.ndarray, cu: np.ndarray, tu: np.ndarray) -> np.ndarray:
        """Averaged probability of each dish, from the parent's and the totals of the contexts."""
        seen = np.maximum(self.c - self.d * self.t, 0)
        p = (seen + (self.s + self.d * tu[self.u]) * p1[self.w]) / (self.s + cu[self.u])
        return np.where(cu[self.u] > 0, p, p1[self.w])


def _answer_schema():
    return "bucket int, home int, blob binary, types bigint, tokens bigint, customers bigint, tables double, hot_u bigint, hot_c double, hot_t double"


def score(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    size, n_rows = docs.select(F.sum(F.octet_length("text")), F.count("*")).first()
    n = max(LEAST_BUCKETS, -(-(size or 0) // BUCKET_BYTES))
    # Contexts that hold more than an eighth of a bucket in a bounded sample: at most 8 n of them.
    few = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_rows // SAMPLE_ROWS))) == 0).select("text").limit(2 * SAMPLE_ROWS)
    ascii_low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = few.select(F.explode_outer(F.regexp_extract_all(ascii_low, F.lit(r"[^ \t-\r]+"), F.lit(0))).alias("w")).where("w IS NOT NULL")
    seen = settle(seen.groupBy("w").count())
    all_seen = seen.agg(F.sum("count")).first()[0] or 0
    frequent = [WordHashes().of(r.w) & HASH for r in seen.where(F.col("count") * (8 * n) > all_seen).collect()]
    hot = np.unique(np.concatenate([np.array([START]), *frequent]).astype(np.uint64))

    def first(key, frame):
        frame = frame.sort_values(["part", "blob"])
        words, u, w, count = gather(frame["blob"].tolist(), False)
        held = Bucket(words, u, w, count, hot, n, int(key[0]))
        asked = words[held.asked]
        c = np.bincount(held.w, held.c, len(words))[held.asked]
        k = np.bincount(held.w, held.last, len(words))[held.asked]
        home = bucket_of(asked, asked, np.zeros(0, np.uint64), n)
        none = [None] * 4
        rows = [(int(key[0]), b, pack([hash_bytes(asked[at]), narrow(c[at]), narrow(k[at])]), *none, None, None, None)
                for b in range(n) if len(at := np.flatnonzero(home == b))]
        split = np.flatnonzero(held.is_hot & (held.cu > 0))
        rows += [(int(key[0]), -1, None, *none, int(words[i]), float(held.cu[i]), float(held.tu[i])) for i in split]
        return pd.DataFrame(rows, columns=["bucket", "home", "blob", "types", "tokens", "customers", "tables", "hot_u", "hot_c", "hot_t"])

    def parent(key, frame):
        frame = frame.sort_values("bucket")
        asks = [unpack(b) for b in frame["blob"]]
        lists = [bytes_hash(a[0]) for a in asks]
        words = np.unique(np.concatenate(lists))
        c, k = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        places = [np.searchsorted(words, x) for x in lists]
        for at, a in zip(places, asks):
            c[at] += a[1].astype(np.int64)
            k[at] += a[2].astype(np.int64)
        one = np.zeros(len(words), np.int64)
        base = np.full(len(words), 1 / max(int((k > 0).sum()) * n, 1))
        rng = np.random.default_rng([13, int(key[0])])
        mean, _ = seat(one, k, base, 1, TOP_DISCOUNT, TOP_STRENGTH, np.array([float(n)]), rng)
        weight = (k - TOP_DISCOUNT * mean).astype(np.float32)
        rows = [(int(b), int(key[0]), pack([narrow(c[at]), weight[at]]), None, None, None, None, None, None, None)
                for b, at in zip(frame["bucket"], places)]
        rows.append((-1, int(key[0]), None, int((c > 0).sum()), int(c.sum()), int(k.sum()), float(mean[k > 0].sum()), None, None, None))
        return pd.DataFrame(rows, columns=["bucket", "home", "blob", "types", "tokens", "customers", "tables", "hot_u", "hot_c", "hot_t"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = lambda df, key: df.repartition(max(n, parts), key).groupBy(key)
    asked = settle(grouped(blobs(docs, train, hot, n, False), "bucket").applyInPandas(first, _answer_schema()))
    # At most 8 n + 1 split contexts.
    totals = {r.hot_u: (r.c, r.t) for r in asked.where("home = -1").groupBy("hot_u").agg(F.sum("hot_c").alias("c"), F.sum("hot_t").alias("t")).collect()}
    replies = settle(grouped(asked.where("home >= 0"), "home").applyInPandas(parent, _answer_schema()))
    types, tokens, customers, tables = (x or 0 for x in replies.where("bucket = -1").agg(
        F.sum("types"), F.sum("tokens"), F.sum("customers"), F.sum("tables")).first())
    rest = (TOP_STRENGTH + TOP_DISCOUNT * tables) / (types + 1)

    def second(key, frame, reply):
        frame = frame.sort_values(["part", "blob"])
        parts = frame["part"].to_numpy()
        words, u, w, row, (ids, known, trained, nth), sizes = gather(frame["blob"].tolist(), True)
        part = np.repeat(parts, sizes)
        held = Bucket(words, u, w, trained[row], hot, n, int(key[0]))
        del u
        asked = words[held.asked]
        home = bucket_of(asked, asked, np.zeros(0, np.uint64), n)
        c, weight = np.zeros(len(words), np.int64), np.zeros(len(words))
        for b, blob in zip(reply["home"], reply["blob"]):
            at = held.asked[home == b]
            counts, weights = unpack(blob)
            c[at], weight[at] = counts, weights
        p1 = (weight + rest) / (TOP_STRENGTH + customers)
        cu, tu = held.cu.copy(), held.tu.copy()
        for i in np.flatnonzero(held.is_hot).tolist():
            cu[i], tu[i] = totals.get(int(words[i]), (0.0, 0.0))
        p = held.predict(p1, cu, tu)
        base = np.log10((c + 0.1) / (tokens + 0.1 * (types + 1)))[w]
        size = len(ids)
        sums = [np.bincount(row, minlength=size), np.bincount(row, c[w] > 0, size), np.bincount(row, base, size),
                np.bincount(row, np.log10(p)[held.place], size)]
        frame = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "part": part, "nth": nth,
                              "n_tokens": sums[0].astype(np.int64), "n_known": sums[1].astype(np.int64), "base": sums[2], "score": sums[3]})
        frame.loc[known == 0, "doc_id"] = pd.NA
        return frame.groupby(["doc_id", "part", "nth"], dropna=False, as_index=False).sum()

    told = grouped(blobs(docs, train, hot, n, True), "bucket").cogroup(grouped(replies.where("bucket >= 0").select("bucket", "home", "blob"), "bucket"))
    partial = told.applyInPandas(second, "doc_id bigint, part int, nth bigint, n_tokens bigint, n_known bigint, base double, score double")
    return partial.groupBy("doc_id", "part", "nth").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score")).drop("part", "nth")
