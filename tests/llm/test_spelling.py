"""Spelling variants against all pairs of words that share the rest of a word."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glossagrid.llm import spelling
from glossagrid.llm.queries import QUERIES
from tests.llm.conftest import SMALL


def near_of(words):
    near, rest = defaultdict(set), defaultdict(set)
    for x in words:
        for i in range(len(x)):
            y = x[:i] + x[i + 1:]
            rest[i, y].add(x)
            if y in words:
                near[x].add(y)
                near[y].add(x)
    for held in rest.values():
        for a in held:
            near[a] |= held - {a}
    return near


def groups(words):
    """word: (form, root, n, n_near, form_n)."""
    near, form = near_of(words), {}
    for x in words:
        best = min(near[x], key=lambda y: (-words[y], y), default=None)
        form[x] = best if best is not None and words[best] >= 5 * words[x] else None

    def root(x):
        while form[x] is not None:
            x = form[x]
        return x

    return {x: (form[x], root(x), words[x], len(near[x]), words.get(form[x])) for x in words}


def counted(texts):
    found = Counter()
    for i, text in texts.items():
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def rows_of(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query(spark, small):
    assert rows_of(QUERIES["op12_variable_grams"](spark, SMALL)) == groups(counted(small))


@pytest.mark.parametrize("seed,frequent", [(1, 50), (2, 3), (3, 0), (4, 100_000)])
def test_crowded_words_at_any_pruning(spark, seed, frequent):
    """Few letters, so that nearly all grams are common; chains of forms; words of the least length and long ones."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 7, 8, 13]))): rng.choice([5, 6, 30, 200, 2000, 10_000]) for _ in range(1500)}
    words |= {"a" * k: 5 ** k for k in range(6, 14)} | {"x" * 2000 + "ÿ": 5, "x" * 2000 + "þ": 25, "x" * 2000: 125}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.variants(df, frequent)) == groups(words)


@pytest.mark.parametrize("seed", range(30))
def test_bound_holds_for_every_edit(seed):
    """Two words one edit apart share all but `bound` grams of either."""
    rng = random.Random(seed)
    letters, common = "ab" if seed % 2 else "abcdef", set()
    for w in (2, 3):
        common |= {"".join(rng.choice(letters + "<>") for _ in range(w)) for _ in range(rng.choice([0, 5, 60]))}
    common = {g for g in common if len(g) == 2 or g[:2] in common}

    def grams(word):
        padded, out = "<<<" + word + ">>>", []
        for p in range(len(padded) - 1):
            w = 2
            while w < 4 and padded[p:p + w] in common:
                w += 1
            out.append(min(p + w, len(padded)))
        chosen = spelling.chosen_grams(out)
        return Counter(padded[p:e] for p, e in chosen), len(chosen) - spelling.affected_bound(chosen, len(padded))

    for _ in range(200):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(6, 12)))
        at, c = rng.randrange(len(word) + 1), rng.choice(letters)
        other = rng.choice([word[:at] + c + word[at:], word[:at] + c + word[at + 1:], word[:at] + word[at + 1:]])
        if len(other) < 6:
            continue
        (x, least), (y, least_other) = grams(word), grams(other)
        assert 1 <= max(least, least_other) <= sum((x & y).values())


def test_letters(spark):
    rows = spark.createDataFrame([("ÀBCdé×Z",), ("ÄÖÜßÿA",), ("PLAIN",), ("",)], "run string").select("run", spelling.lowered(F.col("run")).alias("low")).collect()
    assert {r.run: r.low for r in rows} == {"ÀBCdé×Z": "Àbcdé×z", "ÄÖÜßÿA": "ÄÖÜßÿa", "PLAIN": "plain", "": ""}


def test_odd_rows(spark, odd_docs, no_docs):
    more = odd_docs.unionByName(odd_docs)
    texts = more.collect()
    found = Counter()
    for r in texts:
        for w, n in counted({r.doc_id: (r.text + " ") * 5 if r.text else r.text}).items():
            found[w] += n // 5
    got = {r.word: r.n for r in spelling.word_counts(more, occurrences=1).collect()}
    assert got == dict(found) and set(got) >= {"epsilon"}
    assert spelling.variants(spelling.word_counts(no_docs)).count() == 0
    plain = spelling.word_counts(odd_docs, letters=4, occurrences=30_000, every=None)
    assert rows_of(spelling.variants(plain)) == {"wort": (None, "wort", 30_000, 0, None)}
