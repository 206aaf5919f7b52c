"""Deterministic sharded WARC writer.

Records are built and compressed where they are read, one gzip member each, with
headers and digests made anew. Shards are ranges of the key (url, page_id);
their bounds follow from a sample by hash of the keys, so they depend on the
data alone, not on its partitions. A shard's records, shuffled in compressed
form and sorted, are appended to files that roll at a compressed size. A file
has a temporary name until it is whole; the manifest, written last in the same
way, names all files that count. Running again writes the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Uncompressed bytes in a shard, unless that gave more than MOST_SHARDS.
SHARD_BYTES, MOST_SHARDS = 64 << 20, 20_000
#: Compressed bytes at which a file rolls.
FILE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
#: Keys in the sample for the bounds, for each shard, and at most in all.
_KEYS, _MOST_KEYS = 200, 500_000
_RECORD = "shard int, page_id long, url string, digest string, record binary"
_INDEX = "kind string, page_id long, url string, file string, offset long, length long, digest string"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without name or time."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return _member(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n")


def response(url: str, page_id: int | None, html: bytes, date: str = DATE) -> tuple[bytes, str]:
    """Compressed response record of a page, and its payload's digest."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    digest = _sha1(html)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{url}\n{page_id}\n{digest}")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html) + html
    fields = [("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response")]
    return _record("response", fields, block), digest


def _info(file: str, date: str) -> bytes:
    block = b"software: dittograph\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo\n{file}")
    return _record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date), ("WARC-Filename", file), ("Content-Type", "application/warc-fields")], block)


def _compressed(bounds: list[tuple[str, int]], date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                record, digest = response(url, page, html, date)
                rows.append((bisect_right(bounds, (url.encode(), -1 if page is None else page)), page, url, digest, record))
                held += len(record)
                if held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["shard", "page_id", "url", "digest", "record"])


class _Files:
    """The files of one task: open under a temporary name, moved when whole."""

    def __init__(self, uri: str, file_bytes: int, date: str):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)
        self.file_bytes, self.date, self.out, self.rows = file_bytes, date, None, []
        self.attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}" if TaskContext.get() else uuid.uuid4().hex

    def open(self, shard: int, number: int) -> None:
        self.shard, self.number, self.name = shard, number, f"part-{shard:06d}-{number:05d}.warc.gz"
        self.tmp = f"{self.root}/.tmp-{self.name}-{self.attempt}"
        self.out, self.sha, self.size, self.records = self.fs.open_output_stream(self.tmp, compression=None), hashlib.sha256(), 0, 0
        self.write(_info(self.name, self.date))

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.fs.move(self.tmp, f"{self.root}/{self.name}")
            self.rows.append(("file", self.records, None, self.name, None, self.size, "sha256:" + self.sha.hexdigest()))
            self.out = None

    def add(self, shard: int, page: int | None, url: str, digest: str, record: bytes) -> None:
        if self.out and self.shard != shard:
            self.close()
        if self.out and self.records and self.size + len(record) > self.file_bytes:
            self.close()
            self.open(shard, self.number + 1)
        if not self.out:
            self.open(shard, 0)
        self.rows.append(("record", page, url, self.name, self.size, len(record), digest))
        self.write(record)
        self.records += 1


def _appended(uri: str, file_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(uri, file_bytes, date)

        def taken() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            rows, files.rows = files.rows, []
            columns = zip(*rows) if rows else [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["kind", "page_id", "url", "file", "offset", "length", "digest"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "url", "digest", "record"))):
                files.add(*row)
            yield taken()
        files.close()
        yield taken()

    return run


def bounds_of(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[tuple[bytes, int]]:
    """Least key of each shard but the first: exact quantiles of the bytes of a sample chosen by hash of the key."""
    total, count = pages.agg(F.sum(F.octet_length("html")), F.count(F.lit(1))).first()
    shards = min(MOST_SHARDS, -(-(total or 0) // shard_bytes))
    if shards < 2:
        return []
    share = min(1.0, min(_KEYS * shards, _MOST_KEYS) / count)
    picked = pages.filter(F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = sorted((r.url.encode(), -1 if r.page_id is None else r.page_id, r.n) for r in picked.select("url", "page_id", F.octet_length("html").alias("n")).toLocalIterator())
    weight, out, seen = sum(r[2] for r in rows), [], 0
    for url, page, n in rows:
        if seen >= weight * (len(out) + 1) / shards and len(out) < shards - 1 and (not out or out[-1] < (url, page)):
            out.append((url, page))
        seen += n
    return out


def write(pages: DataFrame, uri: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files below ``uri``; returns the index of records.

    The index (page_id, url, file, offset, length, digest) has a row for each
    record: where its gzip member lies, and its payload's SHA-1. ``MANIFEST.jsonl`` lists
    the files with records, size and SHA-256; files it doesn't name don't count.

    Rows with a null url or html are left out; a null page_id is written. An empty
    html is a record with an empty payload. Repeated rows are written as often as
    they occur. Ties in url go by page_id, then digest. A record longer than
    ``file_bytes`` has a file of its own. An empty table gives a manifest without files.
    Other columns are not read. One shuffle, of the compressed records.
    """
    spark: SparkSession = pages.sparkSession
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).filter("url is not null and html is not null")
    bounds = bounds_of(rows, shard_bytes)
    packed = rows.withColumn("html", F.encode("html", "UTF-8")).mapInArrow(_compressed(bounds, date), _RECORD)
    ordered = packed.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "url", F.col("page_id").asc_nulls_first(), "digest")
    ordered.mapInArrow(_appended(uri, file_bytes, date), _INDEX).write.mode("overwrite").parquet(f"{uri}/index")
    index = spark.read.schema(_INDEX).parquet(f"{uri}/index")
    for f in fs.get_file_info(pafs.FileSelector(root)):  # of attempts that failed
        if f.base_name.startswith(".tmp-"):
            fs.delete_file(f.path)
    tmp = f"{root}/.tmp-MANIFEST-{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp) as out:
        for r in index.filter("kind = 'file'").orderBy("file").toLocalIterator():
            out.write(json.dumps({"file": r.file, "records": r.page_id, "bytes": r.length, "digest": r.digest}).encode() + b"\n")
    fs.move(tmp, f"{root}/MANIFEST.jsonl")
    return index.filter("kind = 'record'").select("page_id", "url", "file", "offset", "length", "digest")


def read(uri: str) -> Iterator[dict]:
    """Records of all files of the manifest, in order: headers, block, file, offset, length. For tests and small sets."""
    fs, root = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(f"{root}/MANIFEST.jsonl") as f:
        names = [json.loads(line)["file"] for line in f.read().splitlines()]
    for name in names:
        with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
            data, at = f.read(), 0
        while at < len(data):
            z = zlib.decompressobj(31)
            raw = z.decompress(data[at:])
            used = len(data) - at - len(z.unused_data)
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield {"headers": fields, "block": rest[: int(fields["Content-Length"])], "file": name, "offset": at, "length": used}
            at += used
