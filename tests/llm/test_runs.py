"""Periodic runs against a scan of every lag."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossagrid.llm import runs
from glossagrid.llm.queries import QUERIES
from tests.llm.conftest import SMALL


def every_lag(w):
    """(start, length, period) by comparing all words at all distances."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def stuttering(rng):
    letters, out = rng.choice([1, 2, 3, 5, 50, 1000]), []
    for _ in range(rng.randint(0, 6)):
        if rng.random() < 0.4:
            out += [str(rng.randrange(letters)) for _ in range(rng.randint(0, 60))]
        else:
            p = rng.randint(1, 70)
            base = [str(rng.randrange(letters)) for _ in range(p)]
            out += [base[i % p] for i in range(int(p * rng.uniform(2, 7)))]
            if rng.random() < 0.3:
                out[rng.randrange(len(out))] = "x"
    return out


@pytest.mark.parametrize("seed", range(40))
def test_texts_together(seed):
    rng = random.Random(seed)
    docs = [stuttering(rng) for _ in range(rng.randint(1, 9))]
    n, found, left = runs.runs_of([" ".join(d) for d in docs])
    assert n == [len(d) for d in docs]
    for d, rows, text in zip(docs, found, left):
        want = every_lag(d)
        assert [(r["start"], r["length"], r["period"]) for r in rows] == want
        assert text == collapsed(d, want)


@pytest.mark.parametrize("q", [1, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65, 128, 129])
@pytest.mark.parametrize("extra", [-1, 0, 3])
def test_least_lengths_at_every_scale(q, extra):
    """A run of just four periods at the borders of the scales is found; one word less is not."""
    length = max(6, 4 * q) + extra
    words = [f"a{k}" for k in range(50)] + [f"p{i % q}" for i in range(length)] + [f"z{k}" for k in range(50)]
    rows = runs.runs_of([" ".join(words)])[1][0]
    want = [] if extra < 0 else [{"start": 50, "length": length, "period": q}]
    assert rows == want


@pytest.mark.parametrize("words", [["w"] * 200_000, [f"w{i % 25_000}" for i in range(200_000)], [f"w{i * i % 70_001}" for i in range(200_000)]])
def test_long_texts_take_time_in_proportion(words):
    began = time.time()
    rows = runs.runs_of([" ".join(words)])[1][0]
    assert time.time() - began < 20 and len(rows) <= 1


def test_query(spark, small):
    rows = {r.doc_id: r for r in QUERIES["op11_multiscale_minimizers"](spark, SMALL).collect()}
    assert len(rows) == len(small)
    for i, text in small.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        n, h = len(w), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = every_lag(w) if n < 3000 else None
        r = rows[i]
        if found is None:
            continue
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda x: (x[0], x[2])))
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, found).encode()).hexdigest()
    assert sum(r.n_runs for r in rows.values()) > 10


def test_odd_rows(spark, odd_docs, no_docs):
    rows = runs.periodic_runs(odd_docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd_docs.collect())
    by = {r.doc_id: r for r in rows}
    assert [(x.start, x.length, x.period) for x in by[8].runs] == [(0, 30_000, 1)] and by[8].collapsed == "wort"
    assert by[6].collapsed == "tie" and by[2].runs == [] and by[2].n_words == 0 and by[4].collapsed == ""
    assert runs.periodic_runs(no_docs).count() == 0
    planted = odd_docs.select(runs.planted(F.col("text"), F.col("doc_id")).alias("t")).collect()
    assert len(planted) == len(rows) and all(r.t is not None for r in planted)
    assert runs.periodic_runs(odd_docs.withColumnRenamed("doc_id", "a b"), "a b").columns == ["a b", "n_words", "runs", "collapsed"]
