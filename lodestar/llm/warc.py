"""WARC archives in Zstandard: a writer, and a reader that checks what it reads.

An archive begins with a skippable frame that holds its dictionary, itself
compressed; then comes one frame per record. The reader loads the dictionary,
decodes frame by frame, and checks the version line, the headers that the
standard demands, the block length, the closing blank lines and the digests.

Of records with equal payloads of at least LEAST_REVISIT bytes, the one of the largest
page_id is a response and the others revisit it: their block ends after the
HTTP header, whose Content-Length still gives the payload's. Smaller payloads
are responses always.

A null html is an empty payload, a null url no target header; a null page_id is
smaller than any other. Rows that repeat the largest id and its payload are responses
each, with one record id, which comes from page and payload (the standard wants ids to differ: give pages different ids). Payloads of any
length go whole; an empty table gives an empty manifest; other columns play no part, whatever their names. Header lines may be folded. Archives are written by the tasks to the folder that all share, under a
name for each attempt; the manifest that Spark commits names the valid ones.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, materialise, scratch_path, shipped, spread, table
from .joins import SHARE

LEAST_REVISIT = 1000
#: The dictionary is trained on so many pages, the least by a hash of their id, and so many characters of each.
SAMPLE_PAGES, SAMPLE_CHARS = 256, 8192
DICTIONARY_BYTES = 32 << 10
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
#: The skippable frame of a dictionary, a plain frame, the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DEMANDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
_READ = 1 << 16


class ArchiveError(ValueError):
    """An archive that is not as the format demands."""


def _opened(path: str, mode: str) -> BinaryIO:
    """A file of the shared folder, local or in any store that Arrow reaches."""
    if path.startswith("file:") or "://" not in path:
        return open("/" + path.removeprefix("file:").lstrip("/"), mode)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_stream(at) if "r" in mode else store.open_output_stream(at)


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary; of too few samples to train on, the samples' own beginning."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    if len(data) < 8:
        return None
    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, revisits: int | None) -> bytes:
    """The bytes of one record. digest: hex SHA-1 of the payload, size its bytes; both are given for revisits too."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisits is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if revisits is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    head.append("WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisits is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(revisits, digest)}", f"X-Refers-To-Page-ID: {revisits}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Writer:
    """Writes records to one archive."""

    def __init__(self, out: BinaryIO, dictionary: bytes = b"", level: int = LEVEL):
        own = _dictionary(dictionary)
        self.out, self.bytes = out, 0
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=own, write_checksum=True, write_content_size=True)
        if own is not None:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.compressor.compress(data))


def frames(source: BinaryIO, name: str = "archive") -> Iterator[bytes]:
    """The decoded frames of an archive, one after another, with bounded read-ahead."""
    data = source.read(8)
    own = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", data[4:])[0]
        packed = source.read(size)
        if len(packed) != size:
            raise ArchiveError(f"{name}: the dictionary is cut short")
        if packed[:4] == struct.pack("<I", FRAME_MAGIC):
            packed = zstandard.ZstdDecompressor().decompress(packed, max_output_size=1 << 27)
        own, data = _dictionary(packed), b""
    decompressor = zstandard.ZstdDecompressor(dict_data=own)
    while True:
        data = data or source.read(_READ)
        if not data:
            return
        frame, out = decompressor.decompressobj(), []
        while True:
            try:
                out.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"{name}: bad frame: {e}") from e
            if frame.eof:
                data = frame.unused_data
                break
            data = source.read(_READ)
            if not data:
                raise ArchiveError(f"{name}: the last frame is cut short")
        yield b"".join(out)


def _headers(data: bytes, name: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", data).split(b"\r\n"):  # a line that begins with white space goes on
        key, colon, value = line.partition(b":")
        if not colon or not key or key != key.strip():
            raise ArchiveError(f"{name}: bad header line {line[:80]!r}")
        out[key.decode().lower()] = value.strip().decode()
    return out


def parse(data: bytes, name: str = "archive") -> dict:
    """One record, checked: page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not blank or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ArchiveError(f"{name}: not a WARC record: {version[:40]!r}")
    h = _headers(lines, name)
    if missing := [x for x in _DEMANDED if x.lower() not in h]:
        raise ArchiveError(f"{name}: no {', '.join(missing)}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError(f"{name}: the block is not of {h['content-length']} bytes and two blank lines")
    block = rest[:-4]

    def sha1(field: str) -> str | None:
        kind, _, value = h.get(field, "").partition(":")
        return base64.b32decode(value).hex() if kind == "sha1" else None

    if (d := sha1("warc-block-digest")) and d != hashlib.sha1(block).hexdigest():
        raise ArchiveError(f"{name}: the block's digest differs")
    http, blank, payload = block.partition(b"\r\n\r\n")
    inner = _headers(http.partition(b"\r\n")[2], name)
    size = inner.get("content-length", "")
    if not blank or not size.isdigit():
        raise ArchiveError(f"{name}: no HTTP header")
    revisit = h["warc-type"] == "revisit"
    digest = sha1("warc-payload-digest")
    if not revisit:
        if len(payload) != int(size):
            raise ArchiveError(f"{name}: the payload has {len(payload)} bytes, not {size}")
        own = hashlib.sha1(payload).hexdigest()
        if digest and digest != own:
            raise ArchiveError(f"{name}: the payload's digest differs")
        digest = own
    elif payload or "warc-refers-to" not in h or digest is None:
        raise ArchiveError(f"{name}: a revisit refers to a record by digest and has no payload")
    number = lambda x: None if x is None else int(x)
    return {
        "page_id": number(h.get("x-page-id")), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "payload": None if revisit else payload,
        "payload_bytes": int(size), "payload_digest": digest, "refers_to": number(h.get("x-refers-to-page-id")),
    }


def _told(rows: DataFrame, first: DataFrame) -> DataFrame:
    """rows with revisits and without the html of those, for the payloads in first (_digest, first).

    A row so settled has a key of its own from then on, so that no payload's copies meet in one task.
    """
    d = rows.join(first, (F.col("_key") == F.col("_digest")) & (F.col("payload_bytes") >= LEAST_REVISIT), "left")
    d = d.withColumn("revisits", F.coalesce("revisits", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))))
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    d = d.withColumns({"html": F.when(F.col("revisits").isNull(), F.col("html")), "_key": F.when(F.col("_digest").isNull(), F.col("_key")).otherwise(own)})
    return d.select(*rows.columns)


def described(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes, revisits: the page_id of the response to revisit, or null.

    Payloads that repeat are broadcast if they are counted few; otherwise those of more than 1 / SHARE of the
    copies are, which are few by arithmetic, and the others meet their copies in a shuffle.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("payload_digest"), F.length(payload).cast("long").alias("payload_bytes"))
    large = rows.filter(F.col("payload_bytes") >= LEAST_REVISIT)
    first = large.groupBy(F.col("payload_digest").alias("_digest")).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = materialise(first, "warc-repeats")
    kinds, copies = first.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sent = F.lit(True) if kinds <= BROADCAST_ROWS else F.col("n") * SHARE > copies
    rows = rows.withColumns({"_key": F.col("payload_digest"), "revisits": F.lit(None).cast(pages.schema["page_id"].dataType)})
    d = _told(rows, F.broadcast(first.filter(sent).drop("n")))
    if kinds > BROADCAST_ROWS:
        d = _told(d, first.filter(~sent).drop("n"))
    return d.select("page_id", "url", "html", "payload_digest", "payload_bytes", "revisits")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) to archives in folder, a shared one; returns the manifest: path, records."""
    # thinned by the hash first, so that the tasks send the driver a few times the sample at most
    thin = F.pmod(F.xxhash64("page_id"), F.lit(max(1, pages.count() // (4 * SAMPLE_PAGES)))) == 0
    sample = pages.filter(thin & (F.length("html") > 0)).select("page_id", F.substring("html", 1, SAMPLE_CHARS).alias("head"))
    dictionary = train([r.head.encode() for r in sample.orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES).collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, writer, path, n, done = None, None, "", 0, []
        for batch in batches:
            for page_id, url, html, digest, size, revisits in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    out = _opened(path, "wb")
                    writer, n = Writer(out, dictionary), 0
                writer.add(record(page_id, url, (html or "").encode(), digest, size, revisits))
                n += 1
                if writer.bytes > ARCHIVE_BYTES:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["path", "records"])

    spark = pages.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return materialise(shipped(described(pages)).mapInArrow(run, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of the archives that manifest names (path, records), checked."""
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    kinds += [("payload", pa.binary())] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds], names=[k for k, _ in kinds])

        for b in batches:
            for path, n in zip(b.column("path").to_pylist(), b.column("records").to_pylist(), strict=True):
                rows, seen, held = [], 0, 0
                with _opened(path, "rb") as source:
                    for frame in frames(io.BufferedReader(source) if isinstance(source, io.RawIOBase) else source, path):
                        rows.append(parse(frame, path))
                        seen, held = seen + 1, held + len(frame)
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if seen != n:
                    raise ArchiveError(f"{path}: {seen} records, not {n}")
                yield batch(rows)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    # one archive is at most ARCHIVE_BYTES and a record: each is a task's work
    many = manifest.repartition(max(1, manifest.count()), "path")
    return shipped(many).mapInArrow(run, schema + ", payload binary" * payload)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(spread(table(spark, sf_dir, "pages"), 1 << 20), scratch_path(spark, "warc"))
    return read_archives(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
