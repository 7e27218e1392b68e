"""Near-duplicates against all exact links."""

import random
import re
from collections import Counter, defaultdict

import pytest

from glossagrid.llm import lshforest
from glossagrid.llm.components import components
from glossagrid.llm.queries import QUERIES
from tests.llm.conftest import SMALL


def sets_of(texts, width):
    out = {}
    for i, t in texts.items():
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[i] = frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    return out


def exact(texts, width=3, percent=85):
    """Smallest reachable id, by counting shared shingles of every pair that has any."""
    sets = sets_of(texts, width)
    groups = defaultdict(list)
    for i, s in sets.items():
        groups[s].append(i)
    reps = {min(v): s for s, v in groups.items() if s}
    parent = {i: min(groups[s]) if s else i for i, s in sets.items()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index, shared = defaultdict(list), Counter()
    for i, s in reps.items():
        for x in s:
            index[x].append(i)
    for held in index.values():
        for k, a in enumerate(held):
            for b in held[:k]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(reps[a]) + len(reps[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_documents(spark, small):
    want = exact(small)
    rows = QUERIES["op3_lsh_forest"](spark, SMALL).collect()
    assert len(rows) == len(small)
    for r in rows:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def family(rng, n, base, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 9)}"
        out.append(" ".join(words))
    return out


def test_large_groups_of_near_copies(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(3000)}"
    common = [word() for _ in range(60)]
    texts = family(rng, 300, [word() for _ in range(150)], 4)
    for _ in range(60):
        texts += family(rng, rng.randint(1, 5), common + [word() for _ in range(rng.randint(20, 90))], 3)
    texts += ["a b", "A  b", "b a", "", " ", None, "only"]
    rng.shuffle(texts)
    table = dict(enumerate(texts))
    want = exact(table)
    df = spark.createDataFrame(list(table.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in lshforest.near_duplicates(df).collect()}
    assert got == want


@pytest.mark.parametrize("edits", [(4, 5), (1, 5)])
def test_star_whose_hub_has_the_largest_id(spark, edits):
    """300 copies of 0.86 and more to one original, few of them links of each other."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(300):
        words = list(base)
        for at in rng.sample(range(3, 197), rng.randint(*edits)):
            words[at] = f"x{rng.randrange(10 ** 9)}"
        texts.append(" ".join(words))
    table = dict(enumerate([*texts, " ".join(base)]))
    df = spark.createDataFrame(list(table.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in lshforest.near_duplicates(df).collect()}
    assert got == exact(table)


def test_boilerplate_without_links_lists_few_pairs(spark, monkeypatch):
    """2000 texts that share two thirds and no links, beside copies too far from their original: no pairs of the whole run."""
    rng = random.Random(9)
    common = [f"c{k}" for k in range(90)]
    texts = [" ".join([*common, *(f"{k}o{i}" for i in range(45))]) for k in range(2000)]
    base = [f"b{k}" for k in range(150)]
    for _ in range(300):
        words = list(base)
        for at in rng.sample(range(3, 147), rng.randint(1, 12)):
            words[at] = f"x{rng.randrange(10 ** 9)}"
        texts.append(" ".join(words))
    table = dict(enumerate(texts))
    listed = []
    pairs_of = lshforest._by_differences

    def counted(*a):
        pairs = pairs_of(*a)
        listed.append(pairs.count())
        return pairs

    monkeypatch.setattr(lshforest, "_by_differences", counted)
    df = spark.createDataFrame(list(table.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in lshforest.near_duplicates(df).collect()}
    assert got == exact({i: t for i, t in table.items() if i >= 2000}) | {i: (133, i) for i in range(2000)}
    assert listed and sum(listed) < 20 * len(texts)


def test_differences_of_one_component_make_no_join_rows(spark, monkeypatch):
    """200 texts that share two thirds and no links: each has 45 words of its own, which meet nothing."""
    texts = [" ".join([*(f"c{k}" for k in range(90)), *(f"{k}o{i}" for i in range(45))]) for k in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, join = [], type(df).join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if isinstance(on, list) and on == ["hub", "e"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(type(df), "join", counted)
    assert all(r.component_id == r.doc_id for r in lshforest.near_duplicates(df).collect())
    assert made and sum(made) < len(texts)


def test_sets_meet_beyond_the_hub(spark):
    """Sub-groups of a crowded run that share what its hub lacks, and smaller sets that need nothing beyond it."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(200)]
    texts = [" ".join(base)] * 1
    for g in range(40):
        own = list(base)
        for at in rng.sample(range(5, 195), 9):
            own[at] = f"g{g}w{at}"
        for _ in range(3):
            words = list(own)
            words[rng.randrange(5, 195)] = f"x{rng.randrange(10 ** 9)}"
            texts.append(" ".join(words))
    texts += [" ".join(base[:k]) for k in range(120, 200, 3)] + [" ".join(base[k:]) for k in range(1, 60, 4)]
    for _ in range(60):
        words = list(base)
        for at in rng.sample(range(5, 195), rng.randint(5, 8)):
            words[at] = f"y{rng.randrange(10 ** 9)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    table = dict(enumerate(texts))
    df = spark.createDataFrame(list(table.items()), "doc_id long, text string")
    for width, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in lshforest.near_duplicates(df, width, percent).collect()}
        assert got == exact(table, width, percent)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = lshforest.near_duplicates(odd_docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd_docs.collect())
    by = {r.doc_id: r for r in rows}
    assert by[6].component_id == 5 and not by[6].kept and by[None].component_id is None and by[None].kept
    assert by[2].n_shingles == 0 and by[2].component_id == 2 and by[8].n_shingles == 1 and by[9].kept
    assert lshforest.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("links,want", [
    ([(1, 2), (2, 3), (3, 4), (9, 8)], {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}),
    ([(k, k + 1) for k in range(60)], dict.fromkeys(range(61), 0)),
    ([(100, k) for k in range(5, 40)], {**dict.fromkeys(range(5, 40), 5), 100: 5}),
])
def test_components(spark, links, want):
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)
