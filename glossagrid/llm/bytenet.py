"""Quality by a byte-level convolutional network in numpy.

A text is read as UTF-8 bytes in overlapping chunks that cover all of it. Every byte is
one of 512 symbols: its value, and whether the four bytes from it repeat what
stands 2 to 24 bytes before. Filters 8 symbols wide slide over each chunk, pass a
ramp and are max-pooled; the largest and the mean of the chunks' values enter
one logistic unit. As each filter is a sum of per-symbol table rows, the gradient of a
max-pooled filter touches 8 rows only, so training is cheap. It runs on a bounded
sample of labelled rows: at most EXAMPLES texts, and of each at most TRAIN_CHUNKS
chunks, spread evenly, while scoring always reads whole texts.

Null and empty texts are one chunk of padding and get the network's score for it.
Without both labels in the sample every score is the base rate (0.5 without rows). Equal
texts get equal scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .base import whole
from .labels import labelled

EXAMPLES = 3000  # bounds of the training sample
TRAIN_CHUNKS = 6
FILTERS = 16
WIDTH = 8
STRIDE = 2
CHUNK = 1024
OVERLAP = 64
LAGS = range(2, 25)
EPOCHS = 8
RATE = 0.02
BATCH = 64


def symbols(text: str | None) -> np.ndarray:
    """Byte values, plus 256 where four bytes repeat a near earlier place; padded with zeros to a filter's width."""
    data = np.frombuffer((text or "").encode() + b"\0" * WIDTH, np.uint8)
    quad = np.lib.stride_tricks.sliding_window_view(data, 4)
    quad = np.ascontiguousarray(quad).view(np.uint32).ravel()
    again = np.zeros(len(data), np.uint16)
    for lag in LAGS:
        if lag < len(quad):
            again[lag:len(quad)] |= quad[lag:] == quad[:-lag]
    return data + (again << np.uint16(8))


def chunks(n: int) -> list[tuple[int, int]]:
    """Overlapping (start, end) that cover n symbols."""
    step = CHUNK - OVERLAP
    return [(at, min(at + CHUNK, n)) for at in range(0, max(n - OVERLAP, 1), step)]


def training_chunks(text: str | None) -> list[np.ndarray]:
    """At most TRAIN_CHUNKS chunks, spread evenly over the whole text."""
    held = symbols(text)
    places = chunks(len(held))
    return [held[a:z] for a, z in (places[k] for k in np.unique(np.linspace(0, len(places) - 1, min(len(places), TRAIN_CHUNKS)).astype(int)))]


def respond(table: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Filter responses at every STRIDE-th place: positions x FILTERS."""
    n = (len(held) - WIDTH) // STRIDE + 1
    total = table[0][held[:n * STRIDE:STRIDE]]
    for k in range(1, WIDTH):
        total += table[k][held[k:k + n * STRIDE:STRIDE]]
    return total


class ByteNet:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.15, (WIDTH, 512, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def features(self, text: str | None) -> np.ndarray:
        held = symbols(text)
        pooled = [respond(self.table, held[a:z]).max(0) for a, z in chunks(len(held))]
        pooled = np.maximum(np.array(pooled) + self.bias, 0)
        return np.concatenate([pooled.max(0), pooled.mean(0)])

    def score(self, text: str | None) -> float:
        z = float(self.features(text) @ self.out + self.offset[0])
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))

    def fit(self, held: list[list[np.ndarray]], labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> "ByteNet":
        """Adam on the cross-entropy; `held` has the training chunks of each text."""
        rng = np.random.default_rng(seed)
        y = np.array(labels, np.float32)
        share = y.mean()
        self.offset[0] = np.log(share / (1 - share))
        params = [self.table, self.bias, self.out, self.offset]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, total = 0, epochs * -(-len(y) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), BATCH):
                batch = order[at:at + BATCH]
                grads = [np.zeros_like(p) for p in params]
                for i in batch:
                    places, tops = [], []
                    for c in held[i]:
                        r = respond(self.table, c)
                        where = r.argmax(0)
                        places.append(where)
                        tops.append(r[where, np.arange(FILTERS)])
                    tops = np.array(tops) + self.bias
                    pooled = np.maximum(tops, 0)
                    feats = np.concatenate([pooled.max(0), pooled.mean(0)])
                    p = 1 / (1 + np.exp(-np.clip(feats @ self.out + self.offset[0], -30, 30)))
                    g = (p - y[i]) / len(batch)
                    grads[2] += g * feats
                    grads[3] += g
                    back = np.full(pooled.shape, g / len(pooled), np.float32) * self.out[FILTERS:]
                    back[pooled.argmax(0), np.arange(FILTERS)] += g * self.out[:FILTERS]
                    back *= tops > 0
                    grads[1] += back.sum(0)
                    for c, where, b in zip(held[i], places, back):
                        for k in range(WIDTH):
                            np.add.at(grads[0][k], (c[where * STRIDE + k], np.arange(FILTERS)), b)
                grads[2] += 1e-4 * self.out
                step += 1
                rate = RATE * (1 - step / (total + 1))
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)
        return self


def train(docs: DataFrame, labels: DataFrame, picked: Column, examples: int = EXAMPLES):
    """UDF: text -> score."""
    rows = labelled(docs, labels, "quality", picked, examples)

    @F.pandas_udf("array<binary>")
    def picked_chunks(text: pd.Series) -> pd.Series:
        return pd.Series([[c.astype("<u2").tobytes() for c in training_chunks(t)] for t in text])

    # Bounded: at most `examples` times TRAIN_CHUNKS chunks.
    drawn = sorted(rows.select("doc_id", "label", picked_chunks("text").alias("held")).collect(), key=lambda r: r.doc_id)
    net, base = None, (sum(r.label for r in drawn) / len(drawn) if drawn else 0.5)
    if drawn and 0 < base < 1:
        net = ByteNet().fit([[np.frombuffer(c, "<u2") for c in r.held] for r in drawn], [r.label for r in drawn])

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([net.score(t) if net else base for t in text], dtype=float)

    return score


def score_documents(docs: DataFrame, labels: DataFrame, picked: Column, examples: int = EXAMPLES) -> DataFrame:
    """The rows with `score`; a column of that name is replaced."""
    score = train(docs, labels, picked, examples)
    return docs.withColumn("score", score(whole(F.col("text"))))
