"""Indexes in the shared folder: segments that only grow in number, replaced documents, and merges.

An index is a folder of segments, seg-LOW-HIGH, that stand for the writes LOW to HIGH; one that lies within another's is
no longer read. The first write makes seg-0-0. An upsert indexes the changed documents alone, as one more segment, which also lists the
places of the documents that it replaces and takes their words from the counts. So statistics and searches are those of
an index built anew. Merging writes the blocks of neighbouring segments, without the replaced documents, as one: the newest are
merged for as long as the one before holds no more than FAN times their documents, so each document is written again a few
times, and the segments grow as a power. Only ranges that lost documents are unpacked.

A segment appears whole, by a rename; a writer that is second finds its number taken and fails. Files of merged
segments stay for readers that have begun, until `vacuum`.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import tokens
from ..runtime import scratch_path, shared_dir, shipped
from .index import DOCUMENTS, GONE, Index, _content_key, _rows, block_rows, bucket_of, by_range, exploded, pack, parts_of, parts_schema, places_of, ranges, sized, terms_of, unpack

#: A segment is merged with those after it if it holds at most so many times their documents.
FAN = 4
#: Part of the folder's name: to be raised when the files are written otherwise.
VERSION = 2


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _all(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return []
    names = [re.fullmatch(r"seg-(\d+)-(\d+)", f.getPath().getName()) for f in fs.listStatus(at)]
    return sorted((int(m[1]), int(m[2])) for m in names if m)


def segments(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """The segments to read, oldest first."""
    found = _all(spark, path)
    return [s for s in found if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in found)]


def _name(segment: tuple[int, int]) -> str:
    return "seg-{}-{}".format(*segment)


def _publish(parts: DataFrame, less: DataFrame | None, path: str, segment: tuple[int, int], terms: DataFrame | None = None) -> None:
    """Write a segment; less: term, df to be taken from the counts. The whole appears at once."""
    spark = parts.sparkSession
    own = f"{path}/_{uuid.uuid4().hex}"
    bucketed = parts.repartition("bucket", F.pmod("range", F.lit(_groups(parts)))).sortWithinPartitions("bucket", "term", "range")
    bucketed.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{own}/parts")
    parts.limit(0).write.parquet(f"{own}/kinds")  # a table without documents has no other file
    if terms is None:
        terms = terms_of(_parts(spark, own).filter("bucket >= 0"))
        if less is not None:
            terms = terms.unionByName(less.select("term", (-F.col("df")).alias("df")), allowMissingColumns=True)
    terms.write.option("compression", "zstd").parquet(f"{own}/terms")
    at, fs = _at(spark, own)
    to, _ = _at(spark, f"{path}/{_name(segment)}")
    if fs.exists(to) or not fs.rename(at, to):
        fs.delete(at, True)
        raise FileExistsError(f"{to} was written by another session")


def _groups(parts: DataFrame) -> int:
    """Files that a bucket is dealt to, so that frequent terms' blocks don't meet in one task: by the size of what is read."""
    size = int(str(parts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(size >> 32, 1 << 16))


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{folder}/kinds").schema).parquet(f"{folder}/parts")


def load(spark: SparkSession, path: str, key: str) -> Index | None:
    """The index of that name, or None if there is none."""
    root = f"{path}/{key}"
    return _loaded(spark, [f"{root}/{_name(s)}" for s in segments(spark, root)])


def _loaded(spark: SparkSession, folders: list[str]) -> Index | None:
    if not folders:
        return None
    parts, terms = None, spark.read.parquet(*[f"{f}/terms" for f in folders])
    for f in folders:
        own = _parts(spark, f)
        parts = own if parts is None else parts.unionByName(own)
    if len(folders) > 1:
        terms = terms.groupBy("term").agg(F.sum("df").alias("df"), F.max("most_tf").alias("most_tf"), F.min("least_dl").alias("least_dl")).filter("df > 0")
    return Index(parts, terms, any(not f.endswith("/seg-0-0") for f in folders))


def save(docs: DataFrame, path: str, key: str, tokenise=tokens) -> None:
    """Index documents (doc_id, text) under path as key. Another session that was first wins."""
    try:
        _publish(parts_of(docs, tokenise), None, f"{path}/{key}", (0, 0))
    except FileExistsError:
        return


def kept(docs: DataFrame, tokenise=tokens) -> Index:
    """The index of docs in the shared folder: built and saved at first use, loaded from then on, by this
    session or another; a changed document makes it another index."""
    spark = docs.sparkSession
    path, key = f"{shared_dir(spark)}/lodestar/index-{VERSION}", f"{tokenise.__name__}-{_content_key(docs)}"
    found = load(spark, path, key)
    if found is None:
        save(docs, path, key, tokenise)
        found = load(spark, path, key)
    return found


def upsert(old: DataFrame, new: DataFrame, path: str, key: str, tokenise=tokens) -> None:
    """Bring the index up to date with new (doc_id, text), each id once: they replace those of their ids in old, the
    documents as they are indexed, of which only these are read. A null text takes a document's words away."""
    spark, root = new.sparkSession, f"{path}/{key}"
    found, number = load(spark, path, key), max(hi for _, hi in _all(spark, root)) + 1
    ids = sized(new.select(F.col("doc_id").alias("_id")).distinct())
    held = found.docs.select("range", "lengths", F.posexplode("doc_ids").alias("place", "doc_id")).join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
    dead = _with_gone(held.groupBy("range", "lengths").agg(F.collect_list("place").alias("dead")), found)
    kinds = parts_schema(found.parts.schema["doc_ids"].dataType.elementType)
    gone = dead.mapInArrow(_gone(to_arrow_schema(kinds)), kinds).withColumn("bucket", F.lit(GONE))
    parts = parts_of(new, tokenise, number).unionByName(shipped(gone))
    taken = old.join(ids, F.col("doc_id") == F.col("_id"), "left_semi").select("doc_id", F.array_distinct(tokenise(F.col("text"))).alias("words"))
    less = exploded(taken, F.col("words")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    _publish(parts, less, root, (number, number))
    merge(spark, path, key)


def _with_gone(rows: DataFrame, index: Index) -> DataFrame:
    """rows of ranges, with the packed places that are gone from each."""
    gone = index.parts.filter(F.col("bucket") == GONE).groupBy("range").agg(F.collect_list("places").alias("gone"))
    return rows.join(gone, "range", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<binary>")))


def _gone(schema: pa.Schema):
    """Places that are to go in a range, without those gone before, and what they take from the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                places = np.setdiff1d(r["dead"], unpack(pa.array(r["gone"], pa.binary())))
                lengths = unpack(pa.array([r["lengths"]], pa.binary()))
                if len(places):
                    own = {"range": [r["range"]], "n": [-len(places)], "total": [-int(lengths[places].sum())], "places": pack(places, np.array([0, len(places)]))}
                    yield _rows(schema, 1, own)

    return run


def merge(spark: SparkSession, path: str, key: str, fan: int = FAN) -> None:
    """Merge the newest segments, as the policy says."""
    root = f"{path}/{key}"
    own = segments(spark, root)
    n = [_loaded(spark, [f"{root}/{_name(s)}"]).parts.filter(F.col("bucket") == DOCUMENTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for s in own]
    first, total = len(own) - 1, n[-1]
    while first and n[first - 1] <= fan * total:
        first -= 1
        total += n[first]
    if first == len(own) - 1:
        return
    index = _loaded(spark, [f"{root}/{_name(s)}" for s in own[first:]])
    kinds = parts_schema(index.parts.schema["doc_ids"].dataType.elementType)
    lost = index.parts.filter(F.col("bucket") == GONE)
    here = index.parts.filter(F.col("bucket") == DOCUMENTS).select(F.col("range").alias("_r"))
    touched = sized(lost.select(F.col("range").alias("_t")).distinct())
    left = index.parts.filter("bucket > -2").join(touched, F.col("range") == F.col("_t"), "left_anti")
    docs = _with_gone(index.docs.join(touched, F.col("range") == F.col("_t"), "left_semi"), index).mapInArrow(_holed(to_arrow_schema(kinds)), kinds)
    blocks = block_rows(index.blocks.join(touched, F.col("range") == F.col("_t"), "left_semi"))
    blocks = by_range([*index.lost_places, blocks]).mapInArrow(_thinned(to_arrow_schema(kinds)), kinds)
    parts = left.unionByName(shipped(docs).unionByName(blocks).withColumn("bucket", bucket_of(F.col("term"))))
    if first:  # documents of older segments stay listed as gone
        parts = parts.unionByName(lost.join(here, F.col("range") == F.col("_r"), "left_anti"))
    _publish(parts, None, root, (own[first][0], own[-1][1]), spark.read.parquet(*[f"{root}/{_name(s)}/terms" for s in own[first:]]).groupBy("term").agg(
        F.sum("df").alias("df"), F.max("most_tf").alias("most_tf"), F.min("least_dl").alias("least_dl")
    ).filter("df <> 0"))


def _thinned(schema: pa.Schema):
    """Blocks of ranges without the documents that are gone; the others keep their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in ranges(batches):
            block, place, tf, dl = places_of(own)
            n = np.bincount(block, minlength=own.blocks.num_rows)
            stay = np.flatnonzero(n)
            if not len(stay):
                continue
            cut = np.concatenate([[0], np.cumsum(n[stay])])
            gaps = np.diff(place, prepend=0)
            gaps[cut[:-1]] = place[cut[:-1]]
            yield _rows(schema, len(stay), {
                "range": np.full(len(stay), own.number), "term": own.blocks.column("term").combine_chunks().take(pa.array(stay)), "n": n[stay],
                "most_tf": np.maximum.reduceat(tf, cut[:-1]), "least_dl": np.minimum.reduceat(dl, cut[:-1]), "places": pack(gaps, cut), "tfs": pack(tf, cut), "lengths": pack(dl, cut),
            })

    return run


def _holed(schema: pa.Schema):
    """Rows of ranges' documents, null in place of those that are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                dead, lengths, ids = unpack(pa.array(r["gone"], pa.binary())), unpack(pa.array([r["lengths"]], pa.binary())), r["doc_ids"]
                for p in dead.tolist():
                    ids[p] = None
                yield _rows(schema, 1, {"range": [r["range"]], "n": [r["n"] - len(dead)], "total": [r["total"] - int(lengths[dead].sum())], "lengths": pack(lengths, np.array([0, len(lengths)])), "doc_ids": [ids]})

    return run


def vacuum(spark: SparkSession, path: str, key: str) -> int:
    """Delete segments that others have replaced; how many."""
    root = f"{path}/{key}"
    over = sorted(set(_all(spark, root)) - set(segments(spark, root)))
    for s in over:
        at, fs = _at(spark, f"{root}/{_name(s)}")
        fs.delete(at, True)
    return len(over)


def upserted(old: DataFrame, new: DataFrame, tokenise=tokens) -> Index:
    """The index of old (doc_id, text) after an upsert of new, in a folder of its own."""
    spark = old.sparkSession
    path = scratch_path(spark, "segments")
    save(old, path, "own", tokenise)
    upsert(old, new, path, "own", tokenise)
    return load(spark, path, "own")
