"""WARC archives: exact round trips at any borders, odd payloads, damage."""

import base64
import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from glossagrid.llm import warc
from glossagrid.llm.queries import QUERIES
from glossagrid.session import scratch_path
from tests.llm.conftest import SMALL


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows):
    """(id, bytes, digest, type, refers_to) of (id, payload) rows."""
    first = {}
    for i, p in rows:
        if i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, p in rows:
        to = first.get(p)
        to = None if to == i else to
        out.append((i, len(p), digest(p), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def got(df):
    rows = df.select(warc.row_id(F.col("record_id")).alias("i"), "payload_bytes", F.substring("payload_digest", 6, 32).alias("d"), "type",
                     warc.row_id(F.col("refers_to")).alias("r"), "error").collect()
    assert all(r.error is None for r in rows)
    return sorted([(r.i, r.payload_bytes, r.d, r.type, r.r) for r in rows], key=repr)


def test_query(spark):
    rows = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    out = QUERIES["op13_splittable_reader"](spark, SMALL).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out], key=repr) == expected(rows)


def odd_pages(rng):
    inner = warc.member(warc.record_bytes(99, "http://in/", b"inside", 6, digest(b"inside"), None, "2000-01-01T00:00:00Z"))
    noise = bytes(rng.randrange(256) for _ in range(4000))
    bodies = ["", None, "", "plain", "plain", "é😀", "x" * 300_000, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n", "plain"]
    pages = [(k, f"http://h/{k}", b) for k, b in enumerate(bodies)]
    data = [(100, inner * 3), (101, noise + inner + inner), (102, warc.MAGIC * 50), (103, noise)]
    return pages, data


@pytest.mark.parametrize("range_bytes,file_bytes", [(97, 1 << 20), (1000, 900), (1 << 20, 1)])
def test_ranges_read_each_record_once(spark, range_bytes, file_bytes):
    """Payloads that hold archives and bare magics; tiny ranges and files."""
    rng = random.Random(range_bytes)
    pages, data = odd_pages(rng)
    rows = spark.createDataFrame([(i, u, None if p is None else p.encode()) for i, u, p in pages] + [(i, "u\r\nv w", p) for i, p in data], "id long, uri string, body binary")
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write(warc.records(rows, "id", "uri", "body"), folder, file_bytes)
    back = warc.read(spark, folder, manifest, range_bytes=range_bytes)
    every = [(i, b"" if p is None else p.encode()) for i, _, p in pages] + data
    assert got(back) == expected(every)
    bodies = dict(every)
    for r in back.collect():
        i = int(r.record_id.removeprefix(warc.URN))
        assert r.payload == (None if r.type == "revisit" else bodies[i])
        assert r.uri == (f"http://h/{i}" if i < 100 else "u%0D%0Av%20w")


def test_members_are_plain_gzip():
    data = warc.record_bytes(5, "http://a/", b"body", 4, digest(b"body"), None, "2000-01-01T00:00:00Z")
    packed = warc.member(data) + warc.member(data.replace(b"body", b"next"))
    assert gzip.decompress(packed) == data + data.replace(b"body", b"next")
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"\r\n\r\nbody\r\n\r\n")
    nested = warc.member(b"x" * 10 + packed * 2)
    assert nested.count(warc.MAGIC) == 1 and gzip.decompress(nested) == b"x" * 10 + packed * 2


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at:at + n]


def scan(data, cuts):
    out = []
    for a, z in zip([0, *cuts], [*cuts, len(data)]):
        out += [(offset, head["warc-record-id"], error) for offset, _, head, _, error in warc.Range(Bytes(data), a, z, len(data)).records()]
    return out


@pytest.mark.parametrize("seed", range(20))
def test_any_borders_and_foreign_members(seed):
    """Records start in exactly one range; members that are no records are passed over."""
    rng = random.Random(seed)
    data, want = b"", []
    for k in range(rng.randint(0, 12)):
        if rng.random() < 0.3:
            data += gzip.compress(bytes(rng.randrange(256) for _ in range(rng.randint(0, 300))))
        body = bytes(rng.randrange(rng.choice([2, 256])) for _ in range(rng.choice([0, 3, 500, 9000])))
        want.append((len(data), f"<{warc.URN}{k}>", None))
        data += warc.member(warc.record_bytes(k, "u", body, len(body), digest(body), None, "d"))
    cuts = sorted(rng.sample(range(len(data) + 1), min(len(data), rng.randint(0, 30))))
    assert scan(data, cuts) == want


def test_damage_is_reported_and_passed(spark):
    parts = [warc.member(warc.record_bytes(k, "u", bytes([65 + k]) * 200, 200, digest(b""), None, "d")) for k in range(3)]
    broken = bytearray(b"".join(parts))
    broken[len(parts[0]) + len(parts[1]) - 6] ^= 255  # the check sum of the second member
    rows = scan(bytes(broken), [])
    assert [(i, e is None) for _, i, e in rows] == [(f"<{warc.URN}{k}>", k != 1) for k in range(3)]
    cut = scan(b"".join(parts)[:-5], [])
    assert len(cut) == 3 and cut[2][2] == "the file ends within the record"
    assert zlib.decompress(parts[0], 31).startswith(b"WARC/")


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd_docs.collect()]
    pages = odd_docs.select(F.col("doc_id").alias("page_id"), F.col("score").alias("url"), F.col("text").alias("html"), "ids", "shard")
    assert got(warc.round_trip(pages)) == expected(rows)
    none = no_docs.select(F.col("doc_id").alias("page_id"), F.col("score").alias("url"), F.col("text").alias("html"))
    assert warc.round_trip(none).count() == 0
    longer = got(warc.round_trip(pages, least_bytes=50))
    assert {r[0] for r in longer if r[3] == "revisit"} == {6}
