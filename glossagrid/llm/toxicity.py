"""Toxicity by the nearest labelled examples: exact TF-IDF cosine, block-max index, weighted votes.

The vocabulary is every word of a bounded sample of labelled rows; document
frequencies are counted over all documents. A word's weight is its idf times its
contrast: how far it shifts the odds of the label in the sample, shrunk towards
none for rare words, never below a floor, so every word counts and an exact copy
of an example has cosine 1 with it. The sample's vectors form an inverted index in blocks of
examples: per word and block, the largest weight. Words of many examples are kept
as dense columns beside it, multiplied for many texts at once. A text reads the blocks of the
highest upper bounds, then only those whose bound reaches its k-th best cosine so far, so the k nearest
examples are exact. Their votes, weighted by a power of the cosine and smoothed
by the base rate, become a probability by a logistic curve fitted on the
examples themselves, each without its own vote. The neighbours are the evidence.

Null, empty and unknown-word texts have no neighbours and get the smoothed rate of
such examples. Without training rows every score is 0.5. Equal texts get equal scores. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import spread
from .base import whole
from .labels import labelled

EXAMPLES = 4_000  # bound of the labelled sample, and so of the vocabulary and the index
SHRINK = 10.0  # pseudo-count of a word's odds
CHANCE = 20.0  # chi-squared at which half of a word's shift counts
FLOOR = 0.02  # least contrast
NEAREST = 15
BLOCK = 128
FIRST_BLOCKS = 4
DENSE_SHARE = 1 / 16  # words of more examples may be dense columns
DENSE_TERMS = 1024
TEXTS_AT_ONCE = 64
SLACK = 2e-5  # more than rounding can move a cosine
POWER = 2
SMOOTH = 0.5

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def vocabulary(examples: DataFrame) -> list[str]:
    """All words of the examples, sorted; bounded by the sample."""
    @F.pandas_udf("array<string>")
    def distinct_words(text: pd.Series) -> pd.Series:
        return pd.Series([list(set(words(t))) for t in text], dtype=object)

    each = spread(examples.select("text")).select(F.explode(distinct_words("text")).alias("term"))
    return sorted(each.distinct().toArrow()["term"].to_pylist())


def vector_of(place: dict[str, int], text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary words a text holds, by number, and how often."""
    held = Counter(words(text))
    terms = np.fromiter(map(place.get, held, repeat(-1)), np.int64, len(held))
    counts = np.fromiter(held.values(), np.int64, len(held))
    order = np.argsort(terms)[np.count_nonzero(terms < 0):]
    return terms[order], counts[order]


def document_frequencies(docs: DataFrame, terms: list[str]) -> np.ndarray:
    """In how many documents each term occurs; added up within tasks before anything moves."""
    place = {t: i for i, t in enumerate(terms)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(len(place), np.int64)
        for batch in batches:
            for text in batch["text"]:
                found = set(map(place.get, set(words(text))))
                found.discard(None)
                df[list(found)] += 1
        held = np.flatnonzero(df)
        yield pd.DataFrame({"term": held, "n": df[held]})

    df = np.zeros(len(terms), np.int64)
    if terms:
        counted = docs.select(whole(F.col("text")).alias("text")).mapInPandas(count, "term bigint, n bigint")
        found = counted.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        df[found["term"].to_numpy()] = found["n"].to_numpy()
    return df


def contrast(terms: np.ndarray, labels: np.ndarray, n_terms: int, rate: float) -> np.ndarray:
    """How far each word shifts the log-odds of label 1; `terms` and `labels` have an entry per word of an example.

    A shift counts by its chi-squared (with continuity correction): what chance alone gives is near the floor.
    """
    n = np.bincount(terms, minlength=n_terms)
    ones = np.bincount(terms, labels, minlength=n_terms)
    odds = (ones + SHRINK * rate) / (n - ones + SHRINK * (1 - rate))
    shift = np.abs(np.log(odds * (1 - rate) / rate))
    chi = np.maximum(np.abs(ones - n * rate) - 0.5, 0) ** 2 / (np.maximum(n, 1) * rate * (1 - rate))
    return FLOOR + shift * chi / (chi + CHANCE)


def spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each span, one after the other."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())


class BlockMax:
    """Postings by term, cut into blocks of examples, with the largest weight of each.

    `rows` are (id, label, terms, counts), `idf` the weight of each term.
    """

    def __init__(self, rows: list[tuple], idf: np.ndarray):
        self.idf = idf
        rows = [r for r in rows if len(r[2])]
        # Examples of like vectors stand together, so block maxima are tight.
        rows.sort(key=lambda r: (list(r[2]), r[0]))
        n = len(rows)
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], np.float32)
        self.blocks = -(-n // BLOCK)
        empty = [np.zeros(0)]
        term = np.concatenate([np.asarray(r[2], np.int64) for r in rows] or empty).astype(np.int64)
        weight = np.concatenate([self.weigh(r[2], r[3]) for r in rows] or empty).astype(np.float32)
        example = np.repeat(np.arange(n), [len(r[2]) for r in rows]) if rows else np.zeros(0, np.int64)

        held = np.bincount(term, minlength=len(idf))
        often = np.argsort(-held, kind="stable")[:DENSE_TERMS]
        often = often[held[often] > n * DENSE_SHARE]
        self.column = np.full(len(idf), -1, np.int32)
        self.column[often] = np.arange(len(often))
        apart = self.column[term] >= 0
        self.dense = np.zeros((n, len(often)), np.float32)
        self.dense[example[apart], self.column[term[apart]]] = weight[apart]
        self.columns = np.ascontiguousarray(self.dense.T)

        order = np.lexsort((example[~apart], term[~apart]))
        term, example, self.weight = (x[~apart][order] for x in (term, example, weight))
        self.example = example.astype(np.int32)
        # A pair is a term in a block; its postings stand in a row.
        key = term * max(self.blocks, 1) + example // BLOCK
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        self.pair_begin = np.append(begin, len(key)).astype(np.int32)
        self.pair_block = (example[begin] // BLOCK).astype(np.int32)
        self.pair_most = np.maximum.reduceat(self.weight, begin) if len(begin) else np.zeros(0, np.float32)
        self.term_begin = np.searchsorted(term[begin], np.arange(len(idf) + 1)).astype(np.int32)

    def weigh(self, terms, counts) -> np.ndarray:
        w = (1 + np.log(np.asarray(counts, np.float32))) * self.idf[np.asarray(terms, np.int64)]
        return (w / np.sqrt((w * w).sum())).astype(np.float32)

    def _partial(self, begin: np.ndarray, end: np.ndarray, query: np.ndarray) -> np.ndarray:
        """The cosine of each example over spans of postings, each times its query weight."""
        at = spans(begin, end - begin)
        return np.bincount(self.example.take(at), np.repeat(query, end - begin) * self.weight.take(at), len(self.ids))

    def dense_parts(self, texts: list[tuple]) -> np.ndarray:
        """Each text's share of the cosine with every example that the dense columns give, all in one product."""
        query = np.zeros((len(texts), len(self.columns)), np.float32)
        for row, (terms, counts) in zip(query, texts):
            column = self.column[np.asarray(terms, np.int64)]
            row[column[column >= 0]] = self.weigh(terms, counts)[column >= 0]
        return query @ self.columns

    def nearest_of(self, texts: list[tuple], k: int = NEAREST, skips: list | None = None) -> list[tuple]:
        """`nearest` of each (terms, counts)."""
        found = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            some = texts[at:at + TEXTS_AT_ONCE]
            left = skips[at:at + TEXTS_AT_ONCE] if skips else [None] * len(some)
            found += [self.nearest(*text, k, skip, dense) for text, skip, dense in zip(some, left, self.dense_parts(some))]
        return found

    def nearest(self, terms, counts, k: int = NEAREST, skip: int | None = None, dense: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a positive cosine; ties go to the earlier example.

        `dense` is the row of `dense_parts`. The blocks of the highest bounds are read first;
        then only those whose bound reaches the k-th best cosine so far can hold a nearer example.
        """
        if not len(terms) or not self.blocks:
            return np.zeros(0, np.int64), np.zeros(0)
        dense = self.dense_parts([(terms, counts)])[0] if dense is None else dense
        query, terms = self.weigh(terms, counts), np.asarray(terms, np.int64)
        column = self.column[terms]
        common, columns = query[column >= 0], column[column >= 0]
        terms, query = terms[column < 0], query[column < 0]
        begin, end = self.term_begin[terms], self.term_begin[terms + 1]
        pairs, each = spans(begin, end - begin), np.repeat(query, end - begin)
        block = self.pair_block.take(pairs)
        bound = np.bincount(block, each * self.pair_most.take(pairs), self.blocks) + np.maximum.reduceat(dense, np.arange(0, len(dense), BLOCK))

        def read(blocks):
            """Cosines of the blocks' examples without their dense part; nothing for others."""
            held = np.flatnonzero(blocks[block])
            at = pairs[held]
            return self._partial(self.pair_begin[at], self.pair_begin[at + 1], each[held])

        def kth(cosine):
            return np.partition(cosine, -k)[-k] if len(cosine) >= k else 0.0

        apart = None if skip is None else self.ids == skip
        seen, partial, least = np.zeros(self.blocks, bool), np.zeros(len(dense)), 0.0
        if self.blocks > 2 * FIRST_BLOCKS:
            seen[np.argpartition(-bound, FIRST_BLOCKS)[:FIRST_BLOCKS]] = True
            partial = read(seen)
            lower = partial + dense  # no example's cosine is less
            least = kth(lower if apart is None else lower[~apart]) - SLACK
        partial = partial + read((bound >= least) & ~seen)
        cosine = partial + dense
        if apart is not None:
            cosine[apart] = 0
        found = np.flatnonzero(cosine >= max(kth(cosine) - SLACK, 1e-12))
        # The product's last digits depend on the texts beside this one; the final cosines don't.
        cosine = partial[found] + self.dense[found[:, None], columns] @ common
        nearest = np.lexsort((found, -np.round(cosine, 5)))[:k]
        return found[nearest], cosine[nearest]


def votes(index: BlockMax, base: float, best: np.ndarray, cosine: np.ndarray) -> float:
    weight = cosine.astype(np.float64) ** POWER
    return float((weight @ index.labels[best] + SMOOTH * base) / (weight.sum() + SMOOTH))


def calibrate(raw: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the log-odds of the raw votes, by Newton's method."""
    x = np.column_stack([np.log(raw / (1 - raw)), np.ones(len(raw))])
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (label - p) - 1e-3 * (beta - [1.0, 0.0]))
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, picked: Column, examples: int = EXAMPLES):
    """UDF: text -> score and evidence (neighbour ids)."""
    sample = labelled(docs, labels, "toxic", picked, examples)
    terms = vocabulary(sample)
    df = document_frequencies(docs, terms)
    idf = np.log((docs.count() + 1) / (df + 1)) + 1 if terms else np.ones(1)
    place = {t: i for i, t in enumerate(terms)}

    @F.pandas_udf("terms array<bigint>, counts array<bigint>")
    def vector(text: pd.Series) -> pd.DataFrame:
        held = [vector_of(place, t) for t in text]
        return pd.DataFrame({"terms": [t for t, _ in held], "counts": [c for _, c in held]})

    # Bounded: at most `examples` sparse vectors.
    got = spread(sample).select("doc_id", "label", vector("text").alias("v")).select("doc_id", "label", "v.*").toArrow()
    rows = list(zip(got["doc_id"].to_pylist(), got["label"].to_pylist(),
                    *[[x.values.to_numpy() for x in got[c]] for c in ("terms", "counts")]))
    base = float(np.mean([r[1] for r in rows])) if rows else 0.5
    if 0 < base < 1 and terms:
        idf = idf * contrast(np.concatenate([r[2] for r in rows]), np.repeat([r[1] for r in rows], [len(r[2]) for r in rows]), len(terms), base)
    index = BlockMax(rows, idf.astype(np.float32))

    # Texts without a neighbour: the smoothed rate among such examples.
    lone = [r[1] for r in rows if not len(r[2])]
    bare = (sum(lone) + base) / (len(lone) + 1)

    @F.pandas_udf("double")
    def without_own_vote(doc_id: pd.Series, text: pd.Series) -> pd.Series:
        found = index.nearest_of([vector_of(place, t) for t in text], skips=doc_id.tolist())
        return pd.Series([votes(index, base, *f) for f in found], dtype="float64")

    slope, offset = 1.0, 0.0
    if 0 < base < 1 and len(lone) < len(rows):
        kept = {r[0] for r in rows if len(r[2])}
        own = spread(sample).select("doc_id", "label", without_own_vote("doc_id", "text").alias("raw")).toArrow().to_pylist()
        own = sorted((r["doc_id"], r["raw"], r["label"]) for r in own if r["doc_id"] in kept)
        slope, offset = calibrate(np.array([x for _, x, _ in own]), np.array([y for _, _, y in own], float))

    def score_of(best, cosine):
        raw = votes(index, base, best, cosine)
        if not len(best):
            return bare, []
        if not 0 < raw < 1:
            return raw, index.ids[best].tolist()
        z = slope * math.log(raw / (1 - raw)) + offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), index.ids[best].tolist()

    @F.pandas_udf("score double, evidence array<bigint>")
    def score(text: pd.Series) -> pd.DataFrame:
        distinct = list(dict.fromkeys(text))
        known = {}
        for at in range(0, len(distinct), TEXTS_AT_ONCE):
            some = distinct[at:at + TEXTS_AT_ONCE]
            known.update(zip(some, (score_of(*f) for f in index.nearest_of([vector_of(place, t) for t in some]))))
        return pd.DataFrame({"score": [known[t][0] for t in text], "evidence": [known[t][1] for t in text]})

    return score


def score_documents(docs: DataFrame, labels: DataFrame, picked: Column, examples: int = EXAMPLES) -> DataFrame:
    """The rows with `score` and `evidence`; columns of those names are replaced."""
    score = train(docs, labels, picked, examples)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "evidence")]
    scored = docs.select(*kept, score(whole(F.col("text"))).alias("scored_"))
    return scored.select(*kept, "scored_.score", "scored_.evidence")
