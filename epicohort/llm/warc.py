"""WARC archives, index first.

Writing: equal payloads of at least ``LEAST_REVISIT`` bytes are stored once. Per
digest the row with the smallest key (ties: the smallest URL; rows alike in all
of it are interchangeable) gets the response record, every other row a revisit
record that names it; shorter payloads are all responses. Each task streams its
records into an archive of its own, every record a gzip member that can be read
by itself, and the only thing it hands on is the index: archive, offset, length,
key, URL, digest of each record. An archive gets a name of its own for each attempt of a
task and counts only through the index rows of the attempt that Spark commits,
so a lost executor or a task that runs twice leaves a file that nothing names,
never a half archive or a record twice.

Reading: index rows of the wanted records are dealt by archive and stretch of
it, sorted by offset, and neighbouring ranges are coalesced into reads of at
most ``READ_BYTES`` (one record at least) over gaps of at most ``GAP_BYTES``, so a full read is sequential
and a selection skips what lies between. A revisit's payload is that of the
response that it names.

Archives lie under ``spark.checkpoint.dir`` (any file system that pyarrow opens by its URI).

Defined results: a null payload is empty; a null URL has no target line; a null
key comes after all others and reads back as null; line breaks, spaces and
control characters in a URL are percent-encoded in its header, a key altogether; repeated
rows each get a record; rows of one key are told apart by URL and payload; other
columns are ignored; a payload is written and read whole, whatever its length;
an empty table gives an empty index.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from hashlib import md5
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epicohort.llm.common import ready, stash, union_all
from epicohort.operators.numbering import lookup_join
from epicohort.session import ensure_checkpoint_dir

LEAST_REVISIT = 100
#: Coalesced reads: greatest gap that is read over, and most bytes of one read. Index rows of so long a stretch of an archive are one task's.
GAP_BYTES, READ_BYTES, STRETCH_BYTES = 64 << 10, 4 << 20, 64 << 20
#: WARC-Date of all records; a crawl that keeps its times passes its own.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header field with the row's key.
KEY_FIELD = "X-Record-Key"

INDEX = ("archive string, offset bigint, length bigint, record_id string, record_type string, record_key string, url string, "
         "digest string, refers_to string")
_INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()),
                    ("record_type", pa.string()), ("record_key", pa.string()), ("url", pa.string()), ("digest", pa.string()),
                    ("refers_to", pa.string())])
RECORDS = ("record_id string, record_type string, record_key string, url string, refers_to string, digest string, "
           "http string, payload binary")
_RECORDS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("record_key", pa.string()), ("url", pa.string()),
                      ("refers_to", pa.string()), ("digest", pa.string()), ("http", pa.string()), ("payload", pa.binary())])


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if urlsplit(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def header_value(text: str) -> str:
    """A URL as it can stand in a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_bytes(kind: str, record_id: str, key: str | None, url: str | None, digest: str, size: int, payload: bytes | None,
                 refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC record, uncompressed: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if key is not None:
        lines.append(f"{KEY_FIELD}: {quote(key)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], str, bytes]:
    """Header fields (names in lower case), HTTP header and payload of one uncompressed record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    size = int(fields["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError("a WARC record's length is not that of its header")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http.decode(), payload


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
    return packer.compress(data) + packer.flush()


def _record_id(key: str | None, url: str | None, digest: str, copy: int) -> str:
    parts = (key, url, digest, str(copy))
    text = "".join("-" if p is None else f"{len(p)}:{p}" for p in parts)
    return f"urn:uuid:{uuid.UUID(bytes=md5(text.encode(), usedforsecurity=False).digest())}"


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, offset, archive = None, 0, os.path.join(folder, f"{uuid.uuid4().hex}.warc.gz")
        try:
            for batch in batches:
                rows: list[tuple] = []
                for i in range(batch.num_rows):
                    kind, key, url, digest, size, copies, first_copy, of_key, of_url, payload = (c[i].as_py() for c in batch.columns)
                    for copy in range(first_copy, first_copy + copies):
                        own = _record_id(key, url, digest, copy)
                        refers = _record_id(of_key, of_url, digest, 0) if kind == "revisit" else None
                        packed = _gzip(record_bytes(kind, own, key, url, digest, size, payload, refers, date))
                        if out is None:
                            store, path = open_store(archive)
                            out = store.open_output_stream(path, compression=None)
                        out.write(packed)
                        rows.append((archive, offset, len(packed), own, kind, key, url, digest, refers))
                        offset += len(packed)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(_INDEX), _INDEX)], schema=_INDEX)
        finally:
            if out is not None:
                out.close()
    return run


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """Write a record for each row and return the index (``INDEX``), stored as Parquet."""
    spark = pages.sparkSession
    ready(spark)
    folder = os.path.join(ensure_checkpoint_dir(spark), "llm", f"warc-{uuid.uuid4().hex[:12]}")
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    base = pages.select(F.col(key).alias("k"), F.col(url).alias("url"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    short = F.col("size") < LEAST_REVISIT
    rows = stash(base.groupBy("k", "url", "digest", "size", F.when(short, F.col("payload")).alias("payload"))
                 .agg(F.count(F.lit(1)).alias("copies")), "pages")
    rank = F.struct(F.col("k").isNull().alias("no_key"), "k", F.col("url").isNull().alias("no_url"), "url")
    firsts = stash(rows.where(~short).groupBy("digest").agg(F.min(rank).alias("f"))
                   .select("digest", F.col("f.k").alias("of_key"), F.col("f.url").alias("of_url")), "firsts")
    # one payload of each digest is moved, copies go before the shuffle
    contents = base.where(~short).groupBy("digest").agg(F.first("payload").alias("payload"), F.first("size").alias("size"))
    text = lambda c: F.col(c).cast("string").alias(c)
    shape = ["kind", "k", "url", "digest", "size", "copies", "first_copy", "of_key", "of_url", "payload"]
    nothing = {"of_key": F.lit(None).cast("string"), "of_url": F.lit(None).cast("string")}
    responses = firsts.join(contents, "digest").withColumns({"kind": F.lit("response"), "k": F.col("of_key"), "url": F.col("of_url"),
                                                             "copies": F.lit(1).cast("long"), "first_copy": F.lit(0).cast("long")})
    small = rows.where(short).withColumns({"kind": F.lit("response"), "first_copy": F.lit(0).cast("long"), **nothing})
    others = lookup_join(stash(rows.where(~short), "long"), firsts, "digest", "inner")
    own = F.col("k").eqNullSafe(F.col("of_key")) & F.col("url").eqNullSafe(F.col("of_url"))
    revisits = others.withColumns({"kind": F.lit("revisit"), "first_copy": own.cast("long"), "copies": F.col("copies") - own.cast("long")}) \
        .where(F.col("copies") > 0)
    records = union_all(df.select("kind", text("k"), "url", "digest", "size", "copies", "first_copy", text("of_key"), "of_url", "payload")
                        .select(shape) for df in (responses, small, revisits))
    return stash(records.mapInArrow(_writer(folder, date), INDEX), "warc_index")


def _ranges(rows: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """(offset, length) rows in order, in groups that one read covers."""
    group: list[tuple[int, int]] = []
    for offset, length in rows:
        if group and (offset - sum(group[-1]) > GAP_BYTES or offset + length - group[0][0] > READ_BYTES):
            yield group
            group = []
        group.append((offset, length))
    if group:
        yield group


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, source = None, None
    for batch in batches:
        archives = batch.column(0).to_pylist()
        spans = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
        start = 0
        while start < len(spans):
            stop = start
            while stop < len(spans) and archives[stop] == archives[start]:
                stop += 1
            if archives[start] != name:
                if source is not None:
                    source.close()
                name = archives[start]
                store, path = open_store(name)
                source = store.open_input_file(path)
            for group in _ranges(spans[start:stop]):
                first = group[0][0]
                data = source.read_at(sum(group[-1]) - first, first)
                rows = []
                for offset, length in group:
                    fields, http, payload = parse_record(zlib.decompress(data[offset - first:offset - first + length], 16 + zlib.MAX_WBITS))
                    key = fields.get(KEY_FIELD.lower())
                    rows.append((fields["warc-record-id"].strip("<>"), fields["warc-type"], None if key is None else unquote(key),
                                 fields.get("warc-target-uri"), fields.get("warc-refers-to", "").strip("<>") or None,
                                 fields["warc-payload-digest"].partition(":")[2], http, payload if fields["warc-type"] == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORDS)], schema=_RECORDS)
            start = stop
    if source is not None:
        source.close()


def read_records(selected: DataFrame) -> DataFrame:
    """The records (``RECORDS``) of the given index rows, read from their archives."""
    ready(selected.sparkSession)
    stretch = F.floor(F.col("offset") / STRETCH_BYTES).alias("stretch")
    dealt = selected.select("archive", "offset", "length", stretch).repartition("archive", "stretch")
    return dealt.sortWithinPartitions("archive", "offset").select("archive", "offset", "length").mapInArrow(_reader, RECORDS)


def read_back(index: DataFrame, key_type: str = "bigint") -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of all
    records, taken from the archives: digest and size of a response from the
    payload that was read, those of a revisit from the response that it names."""
    payload = F.col("payload")
    read = stash(read_records(index).select(
        "record_id", "record_type", F.col("record_key").cast(key_type).alias("page_id"), "url", "refers_to",
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest")), "records")
    responses = read.where(F.col("record_type") == "response")
    named = responses.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("of_page"), "payload_bytes", "payload_digest")
    revisits = stash(read.where(F.col("record_type") == "revisit").drop("payload_bytes", "payload_digest"), "revisits")
    shape = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    resolved = lookup_join(revisits, named, "refers_to").withColumn("refers_to", F.col("of_page"))
    return responses.withColumn("refers_to", F.lit(None).cast(key_type)).select(shape).unionByName(resolved.select(shape))
