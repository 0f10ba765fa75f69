"""Seekable Zstandard bundles of WARC records.

A bundle is a run of independent Zstandard frames, each with some whole records, closed by the seekable
format's skippable frame: a table of frame sizes and a footer. The index maps a record's key to its bundle,
the frame's place there and the record's offset in the decompressed frame, so one frame is read for one record.

Defined results: a null payload is an empty one. Records with equal payloads of at least `min_revisit_bytes`
bytes share one response, that of the largest key; a null key is below all others. Rows that repeat the
response's key and payload are that same record again and are responses too. An empty table gives no bundle
and an empty index. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import materialise, named, open_store, scratch, ship, spread_join, table

SEEK_TABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "key long, bundle string, frame long, frame_offset long, frame_bytes long, record_offset long, record_bytes long, record_type string"
READ = "key long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _urn(key: int | None) -> str:
    return f"<urn:x-record:{'none' if key is None else key}>"


def record_bytes(key, uri, payload: bytes | None, size: int, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload behind a minimal HTTP header, or a revisit without a payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    kind, block = ("revisit", http) if payload is None else ("response", http + payload)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(key)}", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    if payload is None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Frames of about frame_bytes; add() tells where a record lies, its frame's place is known once flushed."""

    def __init__(self, uri: str, frame_bytes: int, level: int):
        import zstandard

        store, path = open_store(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.out, self.limit = uri, store.open_output_stream(path, compression=None), frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.frames: list[tuple[int, int]] = []
        self.waiting: list[tuple] = []
        self.buffer, self.place = bytearray(), 0

    def add(self, key, record: bytes, kind: str) -> list[tuple]:
        done = self.flush() if self.buffer and len(self.buffer) + len(record) > self.limit else []
        self.waiting.append((key, len(self.buffer), len(record), kind))
        self.buffer += record
        return done

    def flush(self) -> list[tuple]:
        if not self.buffer:
            return []
        packed = self.pack(bytes(self.buffer))
        self.out.write(packed)
        rows = [(key, self.uri, len(self.frames), self.place, len(packed), at, n, kind) for key, at, n, kind in self.waiting]
        self.frames.append((len(packed), len(self.buffer)))
        self.place += len(packed)
        self.buffer, self.waiting = bytearray(), []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        body = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(body)) + body)
        self.out.close()
        return rows


def _arrow(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


_INDEX_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
_INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_READ_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
_READ_NAMES = [x.split()[0] for x in READ.split(", ")]


def _writer(folder: str, frame_bytes: int, bundle_bytes: int, level: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/bundle-{task.partitionId():06d}-{task.taskAttemptId()}"  # an attempt never meets another's file
        bundle, n = None, 0
        for batch in batches:
            rows = []
            for key, uri, payload, size, sha1, refers_to in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if bundle is None:
                    bundle, n = BundleWriter(f"{name}-{n:05d}.warc.zst", frame_bytes, level), n + 1
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                record = record_bytes(key, uri, payload, size, digest, refers_to, date)
                rows += bundle.add(key, record, "revisit" if payload is None else "response")
                if bundle.place > bundle_bytes:
                    rows += bundle.close()
                    bundle = None
            if rows:
                yield _arrow(rows, _INDEX_NAMES, _INDEX_TYPES)
        if bundle is not None:
            yield _arrow(bundle.close(), _INDEX_NAMES, _INDEX_TYPES)

    return write


def write_bundles(
    records: DataFrame, folder: str, key: str, uri: str, payload: str, *, min_revisit_bytes: int = 0, frame_bytes: int = 1 << 18,
    bundle_bytes: int = 1 << 28, level: int = 3, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Writes every row of records into bundles under folder and returns their index (INDEX), which is itself written there.

    One shuffle deals the rows by payload digest; the side of the equal payloads has one small row a payload, and a payload
    that many records share is dealt to several tasks. Only bundles that the index names belong to the archive:
    files of lost attempts are never named."""
    ship(records.sparkSession)
    own = records.select(
        F.col(named(key)).cast("long").alias("key"), F.col(named(uri)).cast("string").alias("uri"), F.coalesce(F.col(named(payload)).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    first = materialise(own.groupBy("sha1").agg(F.max("key").alias("leader"), F.count("*").alias("n")), "payloads")
    joined = spread_join(own, first, "sha1", by="key", n="n")
    alone = (F.col("size") < min_revisit_bytes) | F.col("key").eqNullSafe(F.col("leader"))
    dealt = joined.select("key", "uri", F.when(alone, F.col("payload")).alias("payload"), "size", "sha1", F.when(~alone, F.col("leader")).alias("refers_to"))
    dealt.mapInArrow(_writer(folder, frame_bytes, bundle_bytes, level, date), INDEX).write.option("compression", "zstd").parquet(f"{folder}/index")
    return records.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def seek_table(source) -> list[tuple[int, int, int]]:
    """(place, packed bytes, bytes) of each frame of an open bundle, from its footer."""
    size = source.size()
    source.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable Zstandard file")
    width = 12 if flags & 0x80 else 8
    source.seek(size - 9 - count * width)
    body, place, out = source.read(count * width), 0, []
    for i in range(count):
        packed, plain = struct.unpack_from("<II", body, i * width)
        out.append((place, packed, plain))
        place += packed
    return out


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at a place of a decompressed frame, and the place behind it."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    begin, n = end + 4, int(headers["Content-Length"])
    if data[begin + n : begin + n + 4] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, data[begin : begin + n], begin + n + 4


def _row(headers: dict[str, str], block: bytes, keep: bool) -> tuple:
    key, other = (None if x in (None, "none") else int(x) for x in ((headers.get(h) or "<urn:x-record:none>")[14:-1] for h in ("WARC-Record-ID", "WARC-Refers-To")))
    payload, digest = block[block.index(b"\r\n\r\n") + 4 :], headers["WARC-Payload-Digest"][5:]
    size = int(headers["X-Payload-Length"])
    if headers["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {key} is damaged")
    return key, headers.get("WARC-Target-URI"), size, digest, headers["WARC-Type"], other, payload if keep and headers["WARC-Type"] == "response" else None


def _reader(keep: bool, batch_bytes: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = open_store(uri)
                rows, held = [], 0
                with store.open_input_file(path) as source:
                    for place, packed, plain in seek_table(source):
                        source.seek(place)
                        data, at = unpack(source.read(packed)), 0
                        if len(data) != plain:
                            raise ValueError(f"a frame of {uri} is damaged")
                        while at < len(data):
                            headers, block, at = parse(data, at)
                            rows.append(_row(headers, block, keep))
                            held += len(block) if keep else 100
                        if held > batch_bytes:
                            yield _arrow(rows, _READ_NAMES, _READ_TYPES)
                            rows, held = [], 0
                if rows:
                    yield _arrow(rows, _READ_NAMES, _READ_TYPES)

    return read


def read_bundles(index: DataFrame, *, payloads: bool = True, batch_bytes: int = 1 << 24) -> DataFrame:
    """Every record of the bundles that an index names (READ), frame by frame, each payload held against its digest."""
    ship(index.sparkSession)
    bundles = index.select("bundle").distinct()
    return bundles.repartition(max(1, bundles.count())).mapInArrow(_reader(payloads, batch_bytes), READ)


def _seeker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            store, path = open_store(x["bundle"])
            with store.open_input_file(path) as source:
                source.seek(x["frame_offset"])
                headers, block, _ = parse(unpack(source.read(x["frame_bytes"])), x["record_offset"])
            rows.append(_row(headers, block, True))
        yield _arrow(rows, _READ_NAMES, _READ_TYPES)


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The records (READ) of the keys in the first column of keys, each by one seek and one frame."""
    ship(index.sparkSession)
    wanted = keys.select(F.col(keys.columns[0]).cast("long").alias("key")).distinct()
    return index.join(wanted, "key", "left_semi").mapInArrow(_seeker, READ)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page as a WARC record and reads the archives back."""
    index = write_bundles(table(spark, sf_dir, "pages"), scratch(spark, "warc"), "page_id", "url", "html")
    read = read_bundles(index, payloads=False)
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, upper(sha1(body)) AS x, max(page_id) OVER (PARTITION BY body) AS leader FROM p),
d AS (SELECT *, list_transform(range(0, 8), lambda i:
        (instr('0123456789ABCDEF', x[5*i+1]) - 1) * 65536 + (instr('0123456789ABCDEF', x[5*i+2]) - 1) * 4096
        + (instr('0123456789ABCDEF', x[5*i+3]) - 1) * 256 + (instr('0123456789ABCDEF', x[5*i+4]) - 1) * 16 + instr('0123456789ABCDEF', x[5*i+5]) - 1) AS five FROM h)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(five, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32768 % 32 + 1)::INT, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 1024 % 32 + 1)::INT, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32 % 32 + 1)::INT, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v % 32 + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM leader THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM leader THEN leader END AS refers_to
FROM d
"""
