"""Binary corpora and raw vector files as Spark data sources: spark.read.format("lodestar_corpus" or "lodestar_vectors").

A corpus is a folder of parts, each a data file, an offset file of a 64-bit number for each record, and, once
committed, a list of the parts with their totals. A record: the lengths of id, text and title and a flags byte, then the three
in UTF-8, text and title deflated where they have THRESHOLD bytes or more and get smaller, then zeros up to a multiple of 16.

Vectors are headerless little-endian float32 values, a file or a folder of parts, in order; an id is a place in that order.

Files are read in splits by record: the driver looks at names and sizes only, and each task seeks its own offsets. A data file that ends
early gives the records that are whole. Writers write a file a task; a job that fails deletes what its tasks wrote,
and nothing is visible before the list of parts is. Paths are what pyarrow's filesystems read: local, S3, GCS, HDFS.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

#: Fixed values of the record format: lengths and flags, least size to deflate, alignment.
RECORD = struct.Struct("<QQQB")
THRESHOLD, ALIGNED = 100, 16
TEXT_DEFLATED, TITLE_DEFLATED = 1, 2
#: Bytes of a split, and rows of a batch.
SPLIT, ROWS = 32 << 20, 4096
LIST = "parts.json"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _parts(path: str) -> list[dict]:
    """The committed parts of a folder, in order."""
    fs, at = _fs(path)
    with fs.open_input_stream(f"{at}/{LIST}") as f:
        return json.loads(f.read())["parts"]


@dataclass
class Split(InputPartition):
    """Records first to last - 1 of a part."""

    part: str
    first: int
    last: int
    place: int = 0


@dataclass
class Written(WriterCommitMessage):
    place: int
    part: dict


class _Writer(DataSourceArrowWriter):
    """A file a task; the list of parts at the end."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _name(self) -> str:
        t = TaskContext.get()
        return f"part-{self.job}-{t.partitionId():05d}-{t.taskAttemptId()}"

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = _fs(self.path)
        old = [] if fs.get_file_info(f"{at}/{LIST}").type == pafs.FileType.NotFound else _parts(self.path)
        parts = [m.part for m in sorted((m for m in messages if m), key=lambda m: m.place)]
        kept = parts if self.overwrite else old + parts
        totals = {k: sum(p[k] for p in kept) for k in (kept[0] if kept else {}) if k != "name"}
        with fs.open_output_stream(f"{at}/{LIST}.{self.job}") as f:
            f.write(json.dumps({"parts": kept} | totals).encode())
        fs.move(f"{at}/{LIST}.{self.job}", f"{at}/{LIST}")
        if self.overwrite:
            self._delete([p["name"] for p in old])

    def abort(self, messages: list[Written | None]) -> None:
        """Also what tasks wrote that sent no message."""
        fs, at = _fs(self.path)
        self._delete({f.base_name.split(".")[0] for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if self.job in f.base_name})

    def _delete(self, names) -> None:
        fs, at = _fs(self.path)
        for n in names:
            for end in (".bin", ".idx", ".f32"):
                if fs.get_file_info(f"{at}/{n}{end}").type != pafs.FileType.NotFound:
                    fs.delete_file(f"{at}/{n}{end}")


def _deflated(data: bytes, level: int) -> tuple[bytes, bool]:
    if len(data) >= THRESHOLD and len(small := zlib.compress(data, level)) < len(data):
        return small, True
    return data, False


class CorpusWriter(_Writer):
    def __init__(self, path: str, overwrite: bool, level: int):
        super().__init__(path, overwrite)
        self.level = level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        (fs, at), name = _fs(self.path), self._name()
        fs.create_dir(at, recursive=True)
        part = {"name": name, "records": 0, "bytes": 0, "text_bytes": 0, "deflated": 0}
        with fs.open_output_stream(f"{at}/{name}.bin") as data, fs.open_output_stream(f"{at}/{name}.idx") as index:
            for batch in iterator:
                for row in batch.to_pylist():
                    key, text, title = ((row.get(c) or "").encode("utf-8", "replace") for c in ("doc_id", "text", "title"))
                    part["text_bytes"] += len(text)
                    (text, a), (title, b) = _deflated(text, self.level), _deflated(title, self.level)
                    size = RECORD.size + len(key) + len(text) + len(title)
                    record = RECORD.pack(len(key), len(text), len(title), a * TEXT_DEFLATED | b * TITLE_DEFLATED) + key + text + title
                    index.write(struct.pack("<Q", part["bytes"]))
                    data.write(record + bytes(-size % ALIGNED))
                    part["bytes"] += size + -size % ALIGNED
                    part["records"] += 1
                    part["deflated"] += a or b
        return Written(TaskContext.get().partitionId(), part)


class CorpusReader(DataSourceReader):
    """Equality with ids is decided before text and title are inflated."""

    def __init__(self, path: str, split: int):
        self.path, self.split, self.ids = path, split, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("doc_id",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = own if self.ids is None else self.ids & own
            else:
                yield f

    def partitions(self) -> list[Split]:
        out = []
        for p in _parts(self.path):
            each = max(1, p["records"] * self.split // max(1, p["bytes"]))
            out += [Split(p["name"], i, min(i + each, p["records"])) for i in range(0, p["records"], each)]
        return out or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition.last == partition.first:
            return
        fs, at = _fs(self.path)
        with fs.open_input_file(f"{at}/{partition.part}.idx") as f:
            have = min(partition.last + 1, f.size() // 8)
            offsets = np.frombuffer(f.read_at(max(0, have - partition.first) * 8, partition.first * 8), "<u8").tolist()
        names, rows = ("doc_id", "text", "title"), []
        with fs.open_input_file(f"{at}/{partition.part}.bin") as f:
            end, n = f.size(), partition.last - partition.first
            if not offsets:
                return
            stop = offsets[n] if len(offsets) > n else end
            base, data = offsets[0], memoryview(f.read_at(max(0, min(stop, end) - offsets[0]), min(offsets[0], end)))
            for o in offsets[:n]:
                at_ = o - base
                if at_ + RECORD.size > len(data):
                    break
                a, b, c, flags = RECORD.unpack_from(data, at_)
                at_ += RECORD.size
                if at_ + a + b + c > len(data):
                    break  # the file ends within this record
                key = bytes(data[at_ : at_ + a]).decode()
                if self.ids is not None and key not in self.ids:
                    continue
                text, title = bytes(data[at_ + a : at_ + a + b]), bytes(data[at_ + a + b : at_ + a + b + c])
                rows.append((key, (zlib.decompress(text) if flags & TEXT_DEFLATED else text).decode(), (zlib.decompress(title) if flags & TITLE_DEFLATED else title).decode()))
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], names=names)


class Corpus(DataSource):
    """Options: path; level (of deflating, 6), split (bytes, SPLIT). Null texts and titles are written as empty."""

    @classmethod
    def name(cls) -> str:
        return "lodestar_corpus"

    def schema(self) -> str:
        return "doc_id string, text string, title string"

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> CorpusWriter:
        return CorpusWriter(self.options["path"], overwrite, int(self.options.get("level", 6)))


class VectorWriter(_Writer):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        (fs, at), name = _fs(self.path), self._name()
        fs.create_dir(at, recursive=True)
        part = {"name": name, "records": 0, "values": 0}
        with fs.open_output_stream(f"{at}/{name}.f32") as data:
            for batch in iterator:
                flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype("<f4")
                data.write(flat.tobytes())
                part["records"] += batch.num_rows
                part["values"] += len(flat)
        return Written(TaskContext.get().partitionId(), part)


class VectorReader(DataSourceReader):
    def __init__(self, path: str, split: int, n: int | None):
        self.path, self.split, self.n = path, split, n

    def _files(self) -> list[tuple[str, int]]:
        """Files and how many vectors each has."""
        fs, at = _fs(self.path)
        if fs.get_file_info(at).type == pafs.FileType.File:
            return [(at, self.n)]
        return [(f"{at}/{p['name']}.f32", p["records"]) for p in _parts(self.path)]

    def partitions(self) -> list[Split]:
        fs, _ = _fs(self.path)
        out, place = [], 0
        for name, n in self._files():
            size = fs.get_file_info(name).size
            if size % (4 * n) if n else size:
                raise ValueError(f"{size} bytes of {name} are no {n} vectors of float32")
            each = max(1, self.split // max(1, size // n)) if n else 1
            out += [Split(name, i, min(i + each, n), place) for i in range(0, n, each)]
            place += n
        return out or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(self.path)
        if partition.last == partition.first:
            return
        n = dict(self._files())[partition.part]
        with fs.open_input_file(partition.part) as f:
            width = f.size() // n
            for i in range(partition.first, partition.last, ROWS):
                rows = min(ROWS, partition.last - i)
                values = np.frombuffer(f.read_at(rows * width, i * width), "<f4")
                cut = pa.array(np.arange(rows + 1) * (width // 4), pa.int32())
                ids = pa.array(partition.place + i + np.arange(rows))
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(cut, pa.array(values.astype(np.float32)))], names=["vec_id", "embedding"])


class Vectors(DataSource):
    """Options: path, a file or a folder; n, the vectors of a file; split (bytes, SPLIT). Rows are written in their order; their ids are not."""

    @classmethod
    def name(cls) -> str:
        return "lodestar_vectors"

    def schema(self) -> str:
        return "vec_id long, embedding array<float>"

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options["path"], int(self.options.get("split", SPLIT)), int(self.options["n"]) if "n" in self.options else None)

    def writer(self, schema, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> SparkSession:
    """The session, once it knows the two formats and lets readers take filters."""
    from ..runtime import shipped

    shipped(spark.range(0))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Corpus, Vectors):
        spark.dataSource.register(source)
    return spark
