"""Sparse index: postings in packed blocks by term and range of documents, term and collection statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from ..functions.text import tokens
from ..runtime import BROADCAST_BYTES, BROADCAST_ROWS, materialise, shipped

#: Documents and words of a range, at most but for the last batch; buckets of terms.
RANGE, RANGE_WORDS, BUCKETS = 1024, 1 << 20, 32
#: In place of a bucket: rows of a range's documents, and of documents that are gone.
DOCUMENTS, GONE = -1, -2


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast where it counts `most` rows and BROADCAST_BYTES at most; otherwise Spark shuffles it."""
    width = [F.coalesce(F.octet_length(c).cast("long"), F.lit(0)) if t == "string" else F.lit(16) for c, t in df.dtypes]
    n, size = df.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(width, F.lit(16))), F.lit(0))).first()
    return F.broadcast(df) if n <= most and size <= BROADCAST_BYTES else df


def exploded(df: DataFrame, words: Column, *keep: str | Column) -> DataFrame:
    """keep and each word as term. The outer form is filtered after the fact: for the inner one the
    optimiser would tokenise every text once more, to see whether it has words."""
    return df.select(*keep, F.explode_outer(words).alias("term")).filter(F.col("term").isNotNull())


def term_counts(df: DataFrame, key: str, text: str = "text", out: str = "tf", tokenise=tokens) -> DataFrame:
    """key, term, count of the term in the text."""
    t = exploded(df, tokenise(F.col(text)), key)
    return t.groupBy(key, "term").agg(F.count(F.lit(1)).alias(out))


@dataclass
class Index:
    """parts: rows of blocks, of the documents of a range and of documents that are gone, told by bucket; terms(term, df, most_tf, least_dl).

    A range is a run of documents, numbered in it from 0 by id. A block has the postings of a term in a range: n, the gaps
    between places, the counts and the documents' lengths as packed integers, and the largest count and least length, which
    bound the score of each posting. bucket: by the term's hash. lost: whether documents can be gone.
    """

    parts: DataFrame
    terms: DataFrame
    lost: bool = False

    @property
    def blocks(self) -> DataFrame:
        return self.parts.filter("bucket >= 0").drop("total", "doc_ids")

    @property
    def docs(self) -> DataFrame:
        """range, n, total (words), doc_ids, lengths (packed)."""
        return self.parts.filter(F.col("bucket") == DOCUMENTS).select("range", "n", "total", "doc_ids", "lengths")

    @property
    def stats(self) -> DataFrame:
        """n, avgdl."""
        own = self.parts.filter(F.col("bucket") < 0).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total").alias("_t"))
        return own.select("n", F.try_divide(F.col("_t").cast("double"), "n").alias("avgdl"))

    @property
    def postings(self) -> DataFrame:
        """doc_id, term, tf, dl."""
        kinds = StructType([StructField("doc_id", self.parts.schema["doc_ids"].dataType.elementType)]).add("term", "string").add("tf", "long").add("dl", "long")
        tasks = int(self.parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # what is read is small beside what it unpacks to
        return by_range([named(self.docs), *self.lost_places, block_rows(self.blocks)], tasks).mapInArrow(_unpacked, kinds)

    @property
    def lost_places(self) -> list[DataFrame]:
        """Rows for by_range of the places that are gone; none where none can be."""
        gone = self.parts.filter(F.col("bucket") == GONE).select("range", F.lit(_LOST).alias("kind"), "places")
        return [gone] if self.lost else []


#: Kinds of rows of a range, in their order: documents, places that are gone, queries, blocks.
_NAMES, _LOST, _ASKERS, _BLOCKS = range(4)


def named(docs: DataFrame) -> DataFrame:
    """Rows for by_range of the documents in index.docs, one for each: null lists in the rows of blocks are dear in Arrow."""
    return docs.select("range", F.lit(_NAMES).alias("kind"), F.posexplode("doc_ids").alias("_n", "doc_id")).select("range", "kind", F.col("_n").cast("long").alias("n"), "doc_id")


def askers(left: DataFrame) -> DataFrame:
    """Rows for by_range of the queries, by place, that a range is read for."""
    return left.select("range", F.lit(_ASKERS).alias("kind"), F.col("place").alias("n"))


def block_rows(blocks: DataFrame, *more: str) -> DataFrame:
    return blocks.select("range", F.lit(_BLOCKS).alias("kind"), "term", "n", "places", "tfs", "lengths", *more)


def by_range(rows: list[DataFrame], tasks: int | None = None) -> DataFrame:
    """The rows of each range together, by kind."""
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r, allowMissingColumns=True)
    both = shipped(both)
    both = both.repartition(tasks, "range") if tasks else both.repartition("range")
    return both.sortWithinPartitions("range", "kind", "n")


@dataclass
class Range:
    """What by_range has of a range. Its blocks are as many as its words at most."""

    number: int
    ids: pa.ChunkedArray | None
    gone: list[bytes]
    queries: np.ndarray
    blocks: pa.Table


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[Range]:
    """The ranges of rows sorted by by_range."""
    held: list[pa.RecordBatch] = []

    def parts(last: bool) -> Iterator[Range]:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        number = table.column("range").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        if not last:
            held.extend(table.slice(cut[-2]).to_batches())
            cut.pop()
        kind = table.column("kind").to_numpy()
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            at = a + np.searchsorted(kind[a:z], np.arange(5))
            names, lost, asked, blocks = (table.slice(at[k], at[k + 1] - at[k]) for k in range(4))
            yield Range(int(number[a]), names.column("doc_id") if "doc_id" in table.column_names else None, lost.column("places").to_pylist(), asked.column("n").to_numpy(), blocks)

    for b in batches:
        if b.num_rows:
            held.append(b)
            if sum(x.num_rows for x in held) > 50_000 or b.column("range")[0] != b.column("range")[-1]:
                yield from parts(False)
    if held:
        yield from parts(True)


def pack(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Runs of non-negative integers, as bytes of seven bits each; cut: the n + 1 offsets of the runs."""
    size = 1 + sum((values >= (1 << 7 * i)).astype(np.int64) for i in range(1, 9))
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for i in range(int(size.max(initial=0))):
        own = size > i
        more = (size[own] > i + 1).astype(np.int64) << 7
        out[end[own] - size[own] + i] = (values[own] >> 7 * i & 127) | more
    off = np.concatenate([[0], end])[cut].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(off), pa.py_buffer(out)])


def unpack(packed: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """All integers of all runs."""
    if isinstance(packed, pa.ChunkedArray):
        packed = packed.combine_chunks()
    data = np.frombuffer(b"".join(packed.to_pylist()), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128)
    first = np.concatenate([[0], ends[:-1] + 1])
    shift = 7 * (np.arange(len(data)) - np.repeat(first, ends - first + 1))
    return np.add.reduceat((data & 127).astype(np.int64) << shift, first)


def places_of(own: Range) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all postings of a range's blocks: the block, the document's place, the count and the length, without those gone."""
    blocks = own.blocks
    n = blocks.column("n").to_numpy()
    block, gaps = np.repeat(np.arange(len(n)), n), unpack(blocks.column("places"))
    total = np.cumsum(gaps)
    first = np.cumsum(n) - n
    place = total - np.repeat((total - gaps)[first] if len(first) else first, n)
    tf, dl = unpack(blocks.column("tfs")), unpack(blocks.column("lengths"))
    if own.gone:
        stay = ~np.isin(place, _all_places(own.gone))
        return block[stay], place[stay], tf[stay], dl[stay]
    return block, place, tf, dl


def _all_places(packed: list[bytes]) -> np.ndarray:
    return unpack(pa.array(packed, pa.binary()))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own in ranges(batches):
        if own.blocks.num_rows:
            block, place, tf, dl = places_of(own)
            ids, terms = own.ids.combine_chunks(), own.blocks.column("term").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(place)), terms.take(pa.array(block)), pa.array(tf), pa.array(dl)], names=["doc_id", "term", "tf", "dl"])


def _blocks(segment: int, schema: pa.Schema):
    """Documents' words -> the blocks of ranges of documents, and a row of the documents themselves."""

    def made(number: int, ids: pa.Array, toks: pa.Array) -> Iterator[pa.RecordBatch]:
        order = pc.sort_indices(ids)
        ids, toks = ids.take(order), toks.take(order)
        dl = np.diff(toks.offsets.to_numpy().astype(np.int64))
        coded = toks.flatten().dictionary_encode()
        key, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), dl), return_counts=True)
        word, place = key // len(ids), key % len(ids)
        cut = np.searchsorted(word, np.arange(len(coded.dictionary) + 1))
        gaps = np.diff(place, prepend=0)
        gaps[cut[:-1]] = place[cut[:-1]]
        m = len(coded.dictionary)
        columns = {
            "range": np.full(m, number), "term": coded.dictionary, "n": np.diff(cut), "most_tf": np.maximum.reduceat(tf, cut[:-1]) if m else tf, "least_dl": np.minimum.reduceat(dl[place], cut[:-1]) if m else tf,
            "places": pack(gaps, cut), "tfs": pack(tf, cut), "lengths": pack(dl[place], cut),
        }
        yield _rows(schema, m, columns)
        yield _rows(schema, 1, {"range": [number], "n": [len(ids)], "total": [int(dl.sum())], "lengths": pack(dl, np.array([0, len(dl)])), "doc_ids": [ids]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, words = (segment << 48) | (TaskContext.get().partitionId() << 24), [], 0
        for batch in batches:
            step = max(1, RANGE // 8)
            for i in range(0, batch.num_rows, step):
                held.append(batch.slice(i, step))
                words += len(held[-1].column("toks").flatten())
                if words >= RANGE_WORDS or sum(x.num_rows for x in held) >= RANGE:
                    yield from made(number, *_joined(held))
                    number, held, words = number + 1, [], 0
        if held:
            yield from made(number, *_joined(held))

    return run


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    table = pa.Table.from_batches(held).combine_chunks()
    return tuple(table.column(c).combine_chunks() if isinstance(table.column(c), pa.ChunkedArray) else table.column(c) for c in ("doc_id", "toks"))


def _rows(schema: pa.Schema, n: int, columns: dict) -> pa.RecordBatch:
    """Rows of that schema, null where no column is given."""
    own = [pa.array(columns[f.name], f.type) if f.name in columns and not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(own, schema=schema)


def parts_schema(doc_id: DataType) -> StructType:
    s = StructType().add("range", "long").add("term", "string").add("n", "long").add("most_tf", "long").add("least_dl", "long").add("total", "long")
    return s.add("places", "binary").add("tfs", "binary").add("lengths", "binary").add("doc_ids", ArrayType(doc_id))


def bucket_of(term: Column) -> Column:
    return F.when(term.isNull(), F.lit(DOCUMENTS)).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int"))


def parts_of(docs: DataFrame, tokenise=tokens, segment: int = 0) -> DataFrame:
    """Parts of an index of documents (doc_id, text). Words are counted and packed within their range, without a shuffle."""
    toks = docs.select("doc_id", tokenise(F.col("text")).alias("toks"))
    kinds = parts_schema(toks.schema["doc_id"].dataType)
    made = shipped(toks).mapInArrow(_blocks(segment, to_arrow_schema(kinds)), kinds)
    return made.withColumn("bucket", bucket_of(F.col("term")))


def terms_of(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("most_tf").alias("most_tf"), F.min("least_dl").alias("least_dl"))


def build(docs: DataFrame, tokenise=tokens) -> Index:
    """The index of documents (doc_id, text), for this session; empty documents count in n and in the average length."""
    parts = materialise(parts_of(docs, tokenise), "index")
    return Index(parts, terms_of(parts.filter("bucket >= 0")))


def content_key(rows: DataFrame, *columns: str) -> str:
    """Changes whenever a value of columns, ids and texts if none are named, changes; the order of rows plays no part: a count,
    and two sums of 64-bit hashes, which tell tables apart but for accidents."""
    own = columns or ("doc_id", "text")
    h = [F.coalesce(F.sum(x.cast("decimal(20,0)")), F.lit(0)) for x in (F.xxhash64(*own), F.xxhash64(F.lit(1), *reversed(own)))]
    return "-".join(map(str, rows.agg(F.count(F.lit(1)), *h).first()))


_keys: dict[tuple, str] = {}


def _scanned(rows: DataFrame):
    """The files' relation and the source of each column, if rows is nothing but columns of files, by their own or other
    names, and literals, dealt out anew perhaps; else None."""
    plan = rows._jdf.queryExecution().analyzed()
    wanted = {plan.output().apply(i).exprId().toString(): i for i in range(plan.output().size())}
    sources: dict[int, str] = {}
    while (kind := plan.getClass().getSimpleName()) in ("Project", "Repartition", "SubqueryAlias"):
        for i in range(plan.projectList().size() if kind == "Project" else 0):
            e = plan.projectList().apply(i)
            if e.getClass().getSimpleName() == "Alias" and e.exprId().toString() in wanted:
                place, child = wanted.pop(e.exprId().toString()), e.child()
                if child.getClass().getSimpleName() == "Literal":
                    sources[place] = f"{child.dataType().json()} {child.sql()}"
                elif child.getClass().getSimpleName() != "AttributeReference" or child.exprId().toString() in wanted:
                    return None
                else:
                    wanted[child.exprId().toString()] = place
        plan = plan.children().apply(0)
    if kind != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return None
    own = {plan.output().apply(i).exprId().toString(): plan.output().apply(i).name() for i in range(plan.output().size())}
    if not wanted.keys() <= own.keys():
        return None
    sources |= {place: own[e] for e, place in wanted.items()}
    return plan.relation(), tuple(f"{c}: {sources[i]}" for i, c in enumerate(rows.columns))


def _source(rows: DataFrame) -> tuple | None:
    """What tells a table that is read from files: columns, schema, format, options, and paths, sizes and times of all files."""
    found = _scanned(rows)
    if found is None:
        return None
    spark, (relation, columns) = rows.sparkSession, found
    roots = [relation.location().rootPaths().apply(i).toString() for i in range(relation.location().rootPaths().size())]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select("path", "length", "modificationTime")
    listed = files.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(i), *files.columns).cast("decimal(20,0)")) for i in (1, 2)]).first()
    return (spark.sparkContext.applicationId, columns, relation.dataSchema().json(), relation.fileFormat().toString(), relation.options().toString(), tuple(roots), tuple(listed))


def _content_key(rows: DataFrame, *columns: str) -> str:
    """content_key, remembered for as long as bare files stay what they are; any other table is read each time."""
    source = _source(rows)
    if source is None:
        return content_key(rows, *columns)
    if (source, columns) not in _keys:
        _keys[source, columns] = content_key(rows, *columns)
    return _keys[source, columns]


def idf_bm25(n: Column, df: Column) -> Column:
    """Not smoothed, not floored: negative for a term in over half of the documents."""
    return F.ln((n - df + 0.5) / (df + 0.5))


def idf_tfidf(n: Column, df: Column) -> Column:
    return F.ln(n / (df + 1))


def vocabulary(docs: DataFrame) -> DataFrame:
    """term, term_id from 0 by term. Ids come from counts by leading characters, not from one sorted task."""
    terms = exploded(docs, tokens(F.col("text"))).distinct().withColumn("_p", F.substring("term", 1, 2))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = terms.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    per = per.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy("term"))
    return terms.withColumn("_own", own).join(per, "_p").select("term", (F.col("_before") + F.col("_own") - 1).alias("term_id"))
