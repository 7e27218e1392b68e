"""Learned operators: exact parts against brute force, held-out accuracy, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossagrid.llm import bytenet, pitmanyor, toxicity
from glossagrid.llm.base import WordHashes, fold
from glossagrid.llm.queries import QUERIES
from tests.llm.conftest import SMALL

LARGER = "/root/testdata/sf0.01"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


@pytest.fixture(scope="module")
def larger(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}


def test_language_model_counts_and_gain(spark, larger):
    train = Counter()
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in larger}
    for i, t in larger.items():
        if not held[i]:
            train.update([*words_of(t), None])
    total, kinds = sum(train.values()), len(train)
    rows = QUERIES["op1_pitman_yor"](spark, LARGER).collect()
    assert len(rows) == len(larger)
    gain = Counter()
    for r in rows:
        tokens = [*words_of(larger[r.doc_id]), None]
        base = sum(math.log10((train[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(tokens), total)
        assert r.n_known == sum(train[w] > 0 for w in tokens) and abs(r.base_score - base) < 1e-6 * abs(base)
        assert r.score < 0
        if r.held_out:
            gain["tokens"] += r.n_tokens
            gain["nats"] += (r.score - r.base_score)
    assert gain["nats"] / gain["tokens"] > 0.05


def test_predictions_of_a_context_sum_to_one():
    """Over all words, seen after the context or not, with counts of 0 for those only asked for."""
    rng = np.random.default_rng(6)
    n = 40
    u, w = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    count = rng.poisson(0.8, n * n) * (u % 5 > 0)
    held = pitmanyor.Bucket(np.arange(1, n + 1, dtype=np.uint64), u, w, count, np.zeros(0, np.uint64), 4, 0)
    p1 = rng.random(n)
    p1 /= p1.sum()
    p = np.bincount(held.u, held.predict(p1, held.cu, held.tu), n)
    assert np.allclose(p, 1, atol=1e-9)


@pytest.mark.parametrize("n", [1, 64, 1024, 5000, 70_000])
def test_a_key_holds_bucket_words_and_row(n):
    word, row = pitmanyor.widths(n)
    assert n <= 1 << (64 - 2 * word - row) and word > 7


def test_long_documents_are_cut_into_runs():
    texts = ["a b c", None, " ".join(f"w{i}" for i in range(1000)), ""]
    whole = [WordHashes().of(t) & pitmanyor.HASH for t in texts]
    pieces = {}
    for rows, starts, held in pitmanyor.runs([1, 2, None, 4], texts, [True] * 4, 10, WordHashes(), 8, 2):
        assert len(rows) <= 4 and sum(map(len, held)) <= 256
        for (_, _, number), start, h in zip(rows, starts, held):
            before = pieces.setdefault(number, [])
            assert start == (before[-1] if before else pitmanyor.START)
            before += h.tolist()
    assert [pieces[10 + k][:-1] for k in range(4)] == [x.tolist() for x in whole]
    assert all(p[-1] == pitmanyor.END for p in pieces.values())


def test_seating_counts_tables_within_bounds():
    rng = np.random.default_rng(1)
    c = np.concatenate([np.zeros(5, int), rng.integers(1, 40, 500), [5000]])
    group = rng.integers(0, 20, len(c))
    mean, last = pitmanyor.seat(group, c, np.full(len(c), 0.01), 20, 0.7, 1.0, np.ones(20), np.random.default_rng(2))
    for t in (mean, last):
        assert (t[c == 0] == 0).all() and (t[c > 0] >= 1).all() and (t <= c).all()
    # With a large base probability new tables are likely, with a small one they are not.
    many, _ = pitmanyor.seat(group, c, np.full(len(c), 0.9), 20, 0.9, 50.0, np.ones(20), np.random.default_rng(2))
    assert many.sum() > 1.5 * mean.sum()


def test_gibbs_agrees_with_enumeration():
    """Two customers of one dish, alone in a restaurant: P(two tables) is known in closed form."""
    d, s, p = 0.5, 1.0, 0.3
    apart = (s + d) * p / ((s + d) * p + 1 - d)
    n = 4000
    mean, _ = pitmanyor.seat(np.arange(n), np.full(n, 2), np.full(n, p), n, d, s, np.ones(n), np.random.default_rng(4))
    assert abs(mean.mean() - 1 - apart) < 0.02


def _expected_tables(n, p, d, s):
    """Mean number of tables of n customers of one dish alone in a restaurant, over all seatings."""
    ways = np.full(n + 1, -np.inf)
    ways[1] = 0.0
    k = np.arange(n + 1)
    for held in range(1, n):
        joined = np.where(k <= held, ways + np.log(np.maximum(held - k * d, 1e-300)), -np.inf)
        ways = np.logaddexp(np.concatenate([[-np.inf], ways[:-1]]), joined)
    weight = ways[1:] + np.cumsum(np.log(s + d * np.arange(n))) + k[1:] * np.log(p)
    weight = np.exp(weight - weight.max())
    return float(weight @ k[1:] / weight.sum())


@pytest.mark.parametrize("n,p,d,s", [(7, 0.4, 0.8, 0.5), (300, 0.05, 0.7, 1.0), (512, 0.3, 0.5, 10.0), (3000, 0.3, 0.5, 10.0), (3000, 0.6, 0.85, 100.0), (4000, 0.2, 0.3, 10.0)])
def test_gibbs_agrees_with_the_exact_expectation_of_a_large_dish(n, p, d, s):
    m = 2000
    mean, last = pitmanyor.seat(np.arange(m), np.full(m, n), np.full(m, p), m, d, s, np.ones(m), np.random.default_rng(5), (60, 10, 2))
    assert abs(mean.mean() / _expected_tables(n, p, d, s) - 1) < 0.04
    assert last.min() >= 1 and last.max() <= n


def test_two_dishes_of_a_restaurant_agree_with_enumeration():
    """Each dish opens tables by what the other holds: the chain meets the joint distribution."""
    d, s, n, p = 0.6, 2.0, (4, 5), (0.3, 0.2)
    ways = pitmanyor.Seatings(d)
    weight = {}
    for i in range(1, n[0] + 1):
        for j in range(1, n[1] + 1):
            own = [np.prod([ways.ratio(np.array([m]), t)[0] for t in range(1, k)]) for m, k in zip(n, (i, j))]
            weight[i, j] = own[0] * own[1] * np.prod(s + d * np.arange(i + j)) * p[0] ** i * p[1] ** j
    norm = sum(weight.values())
    m = 4000
    mean, _ = pitmanyor.seat(np.repeat(np.arange(m), 2), np.tile(n, m), np.tile(p, m), m, d, s, np.ones(m), np.random.default_rng(6))
    for at in (0, 1):
        exact = sum(w * key[at] for key, w in weight.items()) / norm
        assert abs(mean[at::2].mean() - exact) < 0.02


def test_words_with_many_tables_are_seated_whole():
    mean, last = pitmanyor.seat(np.zeros(2, int), np.array([50, 10**9]), np.array([0.5, 0.5]), 1, 0.6, 10.0, np.ones(1), np.random.default_rng(7))
    assert np.isfinite(mean).all() and 1 <= last[0] <= 50 and last[1] > last[0]


def test_blobs_round_trip():
    words = np.sort(np.random.default_rng(3).integers(0, 1 << 56, 100, dtype=np.uint64))
    arrays = [pitmanyor.hash_bytes(words), np.arange(5, dtype=np.uint16), np.zeros(0, np.int64), np.ones(3, np.float32)]
    back = pitmanyor.unpack(pitmanyor.pack(arrays))
    assert (pitmanyor.bytes_hash(back[0]) == words).all() and all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays[1:], back[1:]))
    assert WordHashes().of("A\x0bbé É").tolist() == WordHashes().of(" a bé É").tolist()


def test_odd_rows_in_the_language_model(spark, odd_docs, no_docs):
    rows = pitmanyor.score(odd_docs, fold(F.col("doc_id"), 10) != 0).collect()
    want = Counter((r.doc_id, len(words_of(r.text)) + 1) for r in odd_docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == want
    same = [r.score for r in rows if r.doc_id in (5, 6)]
    assert max(same) - min(same) < 1e-9
    assert pitmanyor.score(no_docs, F.lit(True)).count() == 0
    assert all(np.isfinite(r.score) and r.train_tokens == 0 for r in pitmanyor.score(odd_docs, F.lit(False)).collect())


def accuracy(rows, truth):
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    hits = [s for s, y in held if y]
    misses = [s for s, y in held if not y]
    return sum((a > b) + 0.5 * (a == b) for a in hits for b in misses) / (len(hits) * len(misses))


@pytest.mark.parametrize("name,label,least", [("op2_nearest_labelled", "toxic", 0.8), ("op7_byte_network", "quality", 0.95)])
def test_held_out_accuracy(spark, larger, name, label, least):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = QUERIES[name](spark, LARGER).collect()
    assert len(rows) == len(larger) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert accuracy(rows, truth) > least
    by = {}
    for r in rows:
        assert by.setdefault(larger[r.doc_id], r.score) == r.score


def test_block_max_finds_the_exact_nearest():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        terms = sorted(rng.choice(60, rng.integers(0, 8), replace=False).tolist())
        rows.append((i, int(rng.integers(0, 2)), terms, rng.integers(1, 5, len(terms)).tolist()))
    index = toxicity.BlockMax(rows, rng.random(60).astype(np.float32) + 0.5)
    dense = {r[0]: np.zeros(60) for r in rows}
    for i, _, terms, counts in rows:
        if terms:
            dense[i][terms] = index.weigh(terms, counts)
    for i, _, terms, counts in rows[:80]:
        best, cosine = index.nearest(terms, counts, 10)
        every = sorted((float(dense[i] @ v) for v in dense.values()), reverse=True)
        want = [x for x in every[:10] if x > 0]
        assert np.allclose(cosine, want, atol=2e-5)
        without, _ = index.nearest(terms, counts, 10, skip=i)
        assert i not in index.ids[without]


def test_nearest_with_dense_columns_is_exact():
    """Frequent terms as dense columns, many blocks, copies: ids and cosines as by brute force."""
    rng = np.random.default_rng(8)
    share = 1 / (1 + np.arange(400)) ** 0.8
    rows = []
    for i in range(3000):
        terms = np.flatnonzero(rng.random(400) < share)
        rows.append((i, int(i % 2), terms, rng.integers(1, 4, len(terms))) if i % 7 or not rows else (i, 0, *rows[-1][2:]))
    weight = rng.random(400).astype(np.float32) + 0.2
    index = toxicity.BlockMax(list(rows), weight)
    assert index.dense.shape[1] > 5 and index.blocks > 2 * toxicity.FIRST_BLOCKS
    every = np.zeros((len(index.ids), 400))
    at = {r[0]: r for r in rows}
    for e, i in enumerate(index.ids.tolist()):
        every[e, at[i][2]] = index.weigh(*at[i][2:])
    for i, _, terms, counts in rows[:150]:
        if not len(terms):
            continue
        for skip in (None, i):
            cosine = every[:, terms] @ index.weigh(terms, counts)
            if skip is not None:
                cosine[index.ids == skip] = 0
            want = np.sort(cosine)[::-1][:15]
            best, found = index.nearest(terms, counts, 15, skip=skip)
            assert np.allclose(found, want[want > 0], atol=2e-5) and np.allclose(cosine[best], found, atol=2e-5)


@pytest.mark.parametrize("rate", [0.1, 0.5, 0.9])
def test_a_telling_word_counts_at_any_base_rate(spark, rate):
    """Each label has its word; rare filler differs in every text. Copies of examples are their own first evidence."""
    n = 200
    rows = [(i, f"filler{i} {'nasty' if i < rate * n else 'kind'} common text", int(i < rate * n)) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, "nasty words unseen"), (1001, "kind words unseen"), (1002, rows[7][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels, F.col("doc_id") % 5 != 0).collect()}
    assert got[1000].score > 0.5 > got[1001].score
    assert got[1002].evidence[0] == 7 and got[1002].score == got[7].score
    assert {w for w in toxicity.vocabulary(docs.limit(2).select("text"))} >= {"common", "text", "filler0"}


def test_document_frequencies_count_documents(spark, odd_docs):
    terms = ["alpha", "one", "tie", "wort"]
    assert toxicity.document_frequencies(odd_docs.select("doc_id", "text"), terms).tolist() == [2, 1, 3, 1]
    assert toxicity.document_frequencies(odd_docs.limit(0), terms).tolist() == [0, 0, 0, 0]


def test_filters_see_the_whole_text():
    assert bytenet.chunks(5000)[0] == (0, 1024) and bytenet.chunks(5000)[-1][1] == 5000
    covered = set()
    for a, z in bytenet.chunks(5000):
        covered |= set(range(a, z))
    assert covered == set(range(5000)) and bytenet.chunks(8) == [(0, 8)]
    s = bytenet.symbols("abcdefgh" + "xyzxyzxyzxyz")
    assert not (s[:8] >> 8).any() and (s[12:16] >> 8).all()


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (bytenet, "quality")])
def test_odd_rows_in_classifiers(spark, odd_docs, no_docs, module, label):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(3, None, 1), (None, 1, 1), (5, 1, 1)], f"doc_id long, {label} int, score int")
    train = F.col("doc_id") % 3 != 0
    rows = module.score_documents(odd_docs, labels, train).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd_docs.collect())
    assert all(0 <= r.score <= 1 for r in rows) and "ids" in rows[0].asDict()
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert module.score_documents(no_docs, labels, train).count() == 0
    assert {r.score for r in module.score_documents(odd_docs, labels.limit(0), train).collect()} == {0.5}


def brute_logit(params, chunk_lists):
    """Convolution as a dense product over one-hot symbols, in float64."""
    table, bias, out, offset = (p.astype(np.float64) for p in params)
    pooled = []
    for held in chunk_lists:
        hot = np.eye(512)[held]
        places = range(0, len(held) - bytenet.WIDTH + 1, bytenet.STRIDE)
        pooled.append(np.max([np.einsum("ks,ksf->f", hot[p:p + bytenet.WIDTH], table) for p in places], axis=0))
    pooled = np.maximum(np.array(pooled) + bias, 0)
    return float(np.concatenate([pooled.max(0), pooled.mean(0)]) @ out + offset[0])


@pytest.mark.parametrize("text", ["", "short", None, "The quick brown fox. " * 9, "é😀 data " * 200])
def test_scores_equal_a_dense_convolution(text):
    net = bytenet.ByteNet()
    net.bias += np.linspace(-0.2, 0.2, len(net.bias)).astype(np.float32)
    held = bytenet.symbols(text)
    logit = brute_logit([net.table, net.bias, net.out, net.offset], [held[a:z] for a, z in bytenet.chunks(len(held))])
    assert abs(net.score(text) - 1 / (1 + math.exp(-logit))) < 1e-5


def test_the_first_step_goes_against_finite_differences():
    """The first step of Adam has the sign of the gradient, wherever that is not near zero."""
    texts, labels = ["alpha beta gamma delta " * 3, "one two three four five"], [1, 0]
    held = [bytenet.training_chunks(t) for t in texts]
    net = bytenet.ByteNet()
    before = [p.copy() for p in (net.table, net.bias, net.out, net.offset)]
    net.fit(held, labels, epochs=1)
    after = [net.table, net.bias, net.out, net.offset]

    def loss(params):
        z = [brute_logit(params, h) for h in held]
        return np.mean([math.log1p(math.exp(-x if y else x)) for x, y in zip(z, labels)]) + 0.5e-4 * float((params[2].astype(np.float64) ** 2).sum())

    rng, checked = np.random.default_rng(1), 0
    seen = [(0, (k, int(held[i][0][k]), f)) for i in (0, 1) for k in range(bytenet.WIDTH) for f in range(4)]
    places = seen + [(1, (int(f),)) for f in rng.choice(len(net.bias), 8, replace=False)] + [(2, (int(f),)) for f in rng.choice(len(net.out), 8, replace=False)]
    for which, at in places:
        wide = [p.astype(np.float64) for p in before]
        wide[which][at] += 1e-5
        up = loss(wide)
        wide[which][at] -= 2e-5
        slope = (up - loss(wide)) / 2e-5
        if abs(slope) > 1e-3:
            checked += 1
            assert np.sign(after[which][at] - before[which][at]) == -np.sign(slope)
    assert checked >= 8
