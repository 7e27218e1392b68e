"""Token output and packing: exact round trips against the tokenizer itself."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from glossagrid.llm import bitplanes, packing
from glossagrid.llm.base import WordIds, default_tokenizer
from glossagrid.llm.queries import QUERIES
from tests.llm.conftest import SMALL


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(default_tokenizer())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shard_bytes_round_trip_and_single_chunks():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, top, n).astype("<u4") for n, top in ((5, 2), (0, 2), (3000, 49408), (8, 1 << 32), (1, 1))]
    shard = bitplanes.Shard(bitplanes.shard_bytes([4, None, 6, 7, 8], [d.tobytes() for d in docs], block=256))
    flat = np.concatenate(docs)
    assert (shard.ids() == flat).all() and (shard.chunk(3) == flat[768:1024]).all()
    assert shard.lengths.tolist() == [5, 0, 3000, 8, 1] and shard.known.tolist() == [True, False, True, True, True]


def test_files_hold_the_tokenizers_ids(spark, small, encode):
    rows = QUERIES["op9_bit_planes"](spark, SMALL).collect()
    start = 0
    assert len(rows) == len(small)
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = encode(small[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_odd_rows_in_files(spark, odd_docs, no_docs, encode):
    back = bitplanes.round_trip(odd_docs, default_tokenizer()).collect()
    want = Counter((r.doc_id, crc(encode(r.text))) for r in odd_docs.collect())
    assert Counter((r.doc_id, zlib.crc32(r.ids)) for r in back) == want
    assert min(back, key=lambda r: r.start).doc_id is None
    assert bitplanes.round_trip(no_docs, default_tokenizer()).count() == 0


@pytest.mark.parametrize("text", ["a  b\tc d e\x85f\x1cg\r\nh", "it's <|endoftext|> now<|startoftext|>x", "é ́e ñ", "𝒳😀  İ", ""])
def test_words_give_the_texts_ids(text, encode):
    assert np.frombuffer(WordIds(default_tokenizer()).encode(text), "<u4").tolist() == encode(text)[:-1]


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_counts_and_is_tight(seed):
    r = random.Random(seed)
    counts = Counter(min(512, int(r.lognormvariate(4.5, 1)) + 1) for _ in range([1, 40, 3000, 20000, 7, 500][seed]))
    used = Counter()
    plans = packing.plan(dict(counts), 512)
    for pattern, times in plans:
        assert sum(pattern) <= 512 and times > 0
        for x in pattern:
            used[x] += times
    assert used == counts
    least = math.ceil(sum(k * v for k, v in counts.items()) / 512)
    assert sum(t for _, t in plans) <= least + max(2, least // 50)


def test_complement_needs_every_copy():
    left = np.zeros(20, np.int64)
    left[4] = 1
    assert packing.complement(8, left, 10) is None
    left[4] = 2
    assert packing.complement(8, left, 10) == (4, 4)
    left[4], left[3] = 1, 2
    assert packing.complement(10, left, 10) == (4, 3, 3)


def check_sequences(rows, texts, encode, capacity=4096):
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(len(encode(t)) for t in texts)
    assert sum(r.length for r in rows) == total
    return len(held), math.ceil(total / capacity)


def test_packed_sequences(spark, small, encode):
    rows = QUERIES["op10_complement_packing"](spark, SMALL).collect()
    n, least = check_sequences(rows, small.values(), encode)
    assert n <= least + 2
    for r in rows:
        ids = encode(small[r.doc_id])
        assert r.start == 4096 * r.piece and r.ids_crc32 == crc(ids[r.start:r.start + r.length])
        assert r.length == min(4096, len(ids) - r.start)


def test_odd_rows_in_sequences(spark, odd_docs, no_docs, encode):
    rows = packing.pack(odd_docs, default_tokenizer()).collect()
    check_sequences(rows, [r.text for r in odd_docs.collect()], encode)
    assert packing.pack(no_docs, default_tokenizer()).count() == 0
