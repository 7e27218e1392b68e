"""WARC archives: written as one gzip member a record, read back in byte ranges.

Writing: rows become `response` records, or `revisit` records where an earlier row (smaller
id) has an equal payload of at least `least_bytes`; a revisit keeps the HTTP header with the
length, names its response and has no payload. Equality is by SHA-1 and a 64-bit hash. Every
task writes files under names of its attempt; the manifest lists those that count. The
payload's gzip magics are parted by flushes, so that an archive within a payload
never stands in the file as such.

Reading: files are cut into byte ranges, each a task's. A task looks for gzip magics in
its range and decodes each candidate's header; a candidate counts if a WARC header
with type and length comes out, its block has that length, the member ends well, and
another member or the file's end follows. A task owns the records that start in its range, reads
the last of them past the border, and never those that start before: so each
record is read once, whatever the borders. A record whose header is
right but whose body is damaged is a row with an `error`, and the search goes on behind its
magic.

A null payload is empty. Rows that share the first id of a payload are all responses, and null ids
revisit known ones (all are responses where no id is known). Line breaks in an address are
escaped. An empty table gives no file and no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import lookup_side, scratch_path, settle

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
FEED = 1 << 14
MORE = 1 << 18
HEADER_BYTES = 1 << 16
HEADER_STEP = 256
LEVEL = 6
# The record's version, the profile of a revisit, and the digits of base 32.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
URN = "urn:row:"


def base32_sha1(data: Column) -> Column:
    """Upper-case base 32 of the SHA-1: ten hexadecimal digits are eight of base 32."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    parts = [F.lpad(F.conv(F.substring(F.sha1(data), 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), digits, BASE32)


def records(rows: DataFrame, key: str, uri: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """id, uri, payload, size, digest and refers_to (null: response) of every row."""
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    held = rows.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{uri}`").cast("string"), F.lit("")).alias("uri"), body.alias("payload"))
    named = held.withColumns({"size": F.octet_length("payload").cast("bigint"), "digest": base32_sha1(F.col("payload")), "mark": F.xxhash64("payload")})
    # Only payloads that occur again need a look; counted before anything moves.
    same = named.where(F.col("size") >= least_bytes).groupBy("digest", "mark", "size").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    again = lookup_side(same.where("n > 1 AND first IS NOT NULL").drop("n"))
    joined = named.join(again, ["digest", "mark", "size"], "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("id", "uri", "payload", "size", "digest", refers.alias("refers_to"))


def record_bytes(row_id: int | None, uri: str, payload: bytes, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record: WARC header, HTTP header and, for a response, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if row_id is None else row_id}>",
             f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', uri)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member; no magic of the data is ever copied whole into it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    out, at = [], 0
    hit = data.find(MAGIC)
    while hit >= 0:
        out += [packer.compress(data[at:hit + 1]), packer.flush(zlib.Z_SYNC_FLUSH)]
        at = hit + 1
        hit = data.find(MAGIC, at)
    return b"".join([*out, packer.compress(data[at:]), packer.flush()])


def write(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write `records` into the folder (a URI all executors reach); returns the manifest: file, bytes, records."""
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context, number, out = TaskContext.get(), 0, None
        done: list[tuple[str, int, int]] = []
        name, size, count = "", 0, 0
        try:
            for batch in batches:
                for row in zip(*[batch.column(k) for k in range(6)]):
                    if out is None:
                        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.gz"
                        out, size, count = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    data = member(record_bytes(*[v.as_py() for v in row], date))
                    out.write(data)
                    size, count = size + len(data), count + 1
                    if size >= file_bytes:
                        out.close()
                        done, out, number = [*done, (name, size, count)], None, number + 1
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((name, size, count))
        yield pa.RecordBatch.from_pydict({"file": [d[0] for d in done], "bytes": [d[1] for d in done], "records": [d[2] for d in done]},
                                         schema=pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    listed = rows.select("id", "uri", "payload", "size", "digest", "refers_to")
    return settle(listed.mapInArrow(put, "file string, bytes bigint, records bigint"))


def parse_header(head: bytes) -> dict[str, str] | None:
    """Names (lower case) and values of a WARC header; None if it is none."""
    lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
        return None
    named = {}
    for line in lines[1:]:
        name, mark, value = line.partition(b":")
        if not mark:
            return None
        named[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return named if "warc-type" in named and named.get("content-length", "").isdigit() else None


class Range:
    """The bytes of one range, and those behind it as far as they are needed."""

    def __init__(self, file, begin: int, end: int, size: int):
        self.file, self.begin, self.end, self.size = file, begin, end, size
        self.held, self.at = b"", begin  # held: the bytes from `at` on

    def bytes(self, at: int, n: int) -> bytes:
        """Up to n bytes from a place; places never go back by more than one candidate."""
        if at < self.at or at + n > self.at + len(self.held):
            want = min(max(n, MORE), self.size - at)
            kept = self.held[at - self.at:] if self.at <= at <= self.at + len(self.held) else b""
            more = want - len(kept)
            self.held, self.at = kept + (self.file.read_at(more, at + len(kept)) if more > 0 else b""), at
        return self.held[at - self.at:at - self.at + n]

    def candidate(self, at: int) -> int | None:
        """The next gzip magic that starts at `at` or later, before the range's end."""
        while at < self.end:
            chunk = self.bytes(at, min(MORE, self.end - at + len(MAGIC) - 1))
            hit = chunk.find(MAGIC)
            if hit >= 0:
                return at + hit if at + hit < self.end else None
            if len(chunk) < len(MAGIC):
                return None
            at += len(chunk) - len(MAGIC) + 1
        return None

    def record(self, at: int, strict: bool) -> tuple[dict[str, str] | None, bytes, int, str | None]:
        """(header, block, end, error) of the member at a place; no header: no record.

        strict: another member or the file's end must follow.
        """
        unpack, data, place, head, fed = zlib.decompressobj(31), bytearray(), at, None, b""
        try:
            while not unpack.eof:
                fed = fed or self.bytes(place, FEED)
                if not fed:
                    return head, b"", place, "the file ends within the record"
                # Little by little up to the header's end: a check sum that fails must not hide the header.
                data += unpack.decompress(fed, HEADER_STEP if head is None else 0)
                left = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
                place += len(fed) - len(left)
                fed = left
                if head is None:
                    border = data.find(b"\r\n\r\n")
                    if border < 0:
                        if len(data) > HEADER_BYTES or unpack.eof:
                            return None, b"", place, None
                        if not b"WARC/".startswith(bytes(data[:5])):
                            return None, b"", place, None
                        continue
                    head = parse_header(bytes(data[:border]))
                    if head is None:
                        return None, b"", place, None
                    body = border + 4
        except zlib.error as error:
            return head, b"", place, f"damaged: {error}"
        length = int(head["content-length"])
        if len(data) - body != length + 4 or data[-4:] != b"\r\n\r\n":
            return head, b"", place, "the block has another length than its header says"
        follows = self.bytes(place, len(MAGIC))
        if strict and follows and follows != MAGIC:
            return None, b"", place, None
        return head, bytes(data[body:body + length]), place, None

    def records(self) -> Iterator[tuple[int, int, dict[str, str], bytes, str | None]]:
        """(offset, end, header, block, error) of the records that start in the range."""
        at, chained = self.begin, self.begin == 0
        while (at := self.candidate(at)) is not None:
            head, block, end, error = self.record(at, not chained)
            if head is None or error:
                if head is not None:
                    yield at, end, head, b"", error
                at, chained = at + 1, False
                continue
            yield at, end, head, block, None
            at, chained = end, True


RECORD = ("file string, offset bigint, bytes bigint, type string, record_id string, uri string, date string, refers_to string, "
          "payload_digest string, payload_bytes bigint, payload binary, error string")


def _http(block: bytes) -> tuple[int | None, bytes]:
    """The length that the HTTP header states, and what follows the header."""
    head, _, body = block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
    return int(stated[1]) if stated else None, body


def read(spark: SparkSession, folder: str, manifest: DataFrame, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the files of a manifest (file, bytes), see `RECORD`; `payloads` False leaves the payload null.

    A revisit's payload_bytes and digest are those of the full payload. Responses whose payload has
    not the stated digest or length have an `error`.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64
        import hashlib

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        names = ["file", "offset", "bytes", "type", "record_id", "uri", "date", "refers_to", "payload_digest", "payload_bytes", "payload", "error"]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for name, begin, end, size in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                out, held = [[] for _ in names], 0
                with store.open_input_file(f"{root}/{name}") as file:
                    for offset, stop, head, block, error in Range(file, begin, end, size).records():
                        http = head.get("content-type", "").startswith("application/http")
                        stated, body = _http(block) if http else (None, block)
                        kind, digest = head["warc-type"], head.get("warc-payload-digest")
                        if error is None and kind == "response":
                            own = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
                            if (digest or "").startswith("sha1:") and digest != own or stated not in (None, len(body)):
                                error = "the payload differs from its digest or length"
                        length = stated if stated is not None else len(body)
                        strip = lambda x: x.strip("<>") if x is not None else None
                        row = (name, offset, stop - offset, kind, strip(head.get("warc-record-id")), head.get("warc-target-uri"), head.get("warc-date"),
                               strip(head.get("warc-refers-to")), digest, length, body if payloads and kind != "revisit" else None, error)
                        for column, value in zip(out, row):
                            column.append(value)
                        held += len(block) if payloads else 64
                        if held >= MORE:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)
                            out, held = [[] for _ in names], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint")))
    cut = manifest.where("bytes > 0").select("file", starts.alias("begin"), F.col("bytes").alias("size"))
    ranges = settle(cut.select("file", "begin", F.least(F.col("begin") + range_bytes, "size").alias("end"), "size"))
    # Few bytes describe much work: one task a range, up to ten tasks a shuffle partition.
    n = max(1, min(ranges.count(), 10 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return ranges.repartition(n).mapInArrow(scan, RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages (page_id, url, html) into a fresh shared folder and read their records back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    manifest = write(records(pages, "page_id", "url", "html", least_bytes), folder)
    return read(spark, folder, manifest, payloads=False)


def row_id(urn: Column) -> Column:
    """The id that a record's name holds; null for none."""
    return F.substring(urn, len(URN) + 1, 20).try_cast("bigint")
