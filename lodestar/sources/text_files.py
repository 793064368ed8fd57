"""Readers and validators of JSON-lines and TSV data. A line table has ord, the line's place, and line.

JSON null counts as missing. Where an id occurs again, the last line wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..runtime import shipped

#: Bytes of a file that is read at once for its checksum, at most.
WHOLE = 256 << 20
#: Field names in order of preference.
DOC_IDS, DOC_TEXTS = ("id", "_id", "doc_id", "docid"), ("text", "content", "body", "passage", "document")
QUERY_IDS, QUERY_TEXTS = ("id", "_id", "query_id", "qid"), ("text", "query", "title", "question", "body")
#: Fixed value: any of these in the first line of judgements makes it a header, where reading is strict.
HEADS = ("query", "doc", "rel", "score")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """ord from 1 and line of a text file, or of a folder's files by name. Files are read in splits: lines are
    counted by split, then numbered within, so that no task holds a file."""
    read = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    per = read.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    per = per.select(F.col("_f").alias("_file"), F.col("_b").alias("_block"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_i"))
    d = read.withColumn("_i", F.monotonically_increasing_id()).withColumn("_own", own)
    d = d.join(per, (F.col("_f") == F.col("_file")) & (F.col("_b") == F.col("_block")))
    return d.select((F.col("_before") + F.col("_own")).cast("long").alias("ord"), "line")


def _fields(names: tuple[str, ...], also: tuple[str, ...]) -> str:
    return ", ".join(f"`{n}` STRING" for n in dict.fromkeys(names + also))


def _filled(names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.col(f"j.`{n}`"), F.lit("")) for n in names])


def parsed(rows: DataFrame, ids: tuple[str, ...], texts: tuple[str, ...], also: tuple[str, ...] = ()) -> DataFrame:
    """ord, line, j; lines that are blank or no JSON objects fall out."""
    j = F.from_json("line", f"{_fields(ids + texts, also)}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    d = rows.filter(strip(F.col("line")) != "").withColumn("j", j)
    return d.filter(F.col("j").isNotNull() & F.col("j._bad").isNull())


def _last(d: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("ord"))
    return d.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "ord")


def load_corpus(rows: DataFrame) -> DataFrame:
    """doc_id, title, text."""
    d = parsed(rows, DOC_IDS, DOC_TEXTS, ("title",))
    text = F.coalesce(*[F.col(f"j.{n}") for n in DOC_TEXTS])
    name = F.coalesce(_filled(DOC_IDS), F.concat(F.lit("doc_"), F.col("ord")))
    return _last(d.select("ord", name.alias("doc_id"), F.col("j.title").alias("title"), text.alias("text")), "doc_id")


def load_queries(rows: DataFrame) -> DataFrame:
    """qid, text."""
    d = parsed(rows, QUERY_IDS, QUERY_TEXTS)
    name = F.coalesce(_filled(QUERY_IDS), F.concat(F.lit("query_"), F.col("ord")))
    return _last(d.select("ord", name.alias("qid"), strip(_filled(QUERY_TEXTS)).alias("text")), "qid")


def load_qrels(rows: DataFrame, strict: bool = False) -> DataFrame:
    """qid, doc_id, rel. Tabs, else white space, part the fields; a first line that names its columns
    falls out, as do rows of bad numbers. strict takes whole numbers only, and any of HEADS for a name."""
    named = F.lower("line").contains("query")
    for name in HEADS if strict else ():
        named = named | F.lower("line").contains(name)
    head = (F.col("ord") == 1) & named
    parts = F.when(F.contains("line", F.lit("\t")), F.split(strip(F.col("line")), "\t")).otherwise(F.split(strip(F.col("line")), r"\s+"))
    d = rows.filter(~head).select("ord", parts.alias("p")).filter(F.size("p") >= 3)
    number = F.get("p", F.lit(2))
    rel = number.try_cast("int") if strict else number.try_cast("double").cast("int")
    d = d.select("ord", F.get("p", F.lit(0)).alias("qid"), F.get("p", F.lit(1)).alias("doc_id"), rel.alias("rel")).filter("rel IS NOT NULL")
    w = Window.partitionBy("qid", "doc_id").orderBy(F.desc("ord"))
    return d.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "ord")


def error_class(line: Column) -> Column:
    """json: no JSON object; validation: no id or text; ok."""
    j = F.from_json(line, f"{_fields(('_id', 'id'), ('text',))}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    has_id = F.coalesce(F.nullif(j["_id"], F.lit("")), F.nullif(j["id"], F.lit(""))).isNotNull()
    has_text = F.nullif(j["text"], F.lit("")).isNotNull()
    bad = (strip(line) == "") | j.isNull() | j["_bad"].isNotNull()
    return F.when(bad, "json").when(~(has_id & has_text), "validation").otherwise("ok")


def validate_jsonl(rows: DataFrame) -> DataFrame:
    """ord, error of each line that is no JSON object."""
    v = F.try_parse_json("line")
    kind = F.schema_of_variant(v)
    error = F.when(v.isNull(), "invalid JSON").when(~kind.startswith("OBJECT"), "not an object")
    return rows.select("ord", error.alias("error")).filter("error IS NOT NULL")


def validate_records(rows: DataFrame) -> DataFrame:
    """ord, error: _id and text must be there and be strings. Lines that are no JSON have other errors."""
    d = rows.withColumn("v", F.try_parse_json("line")).filter("v IS NOT NULL")
    out = None
    for name in ("_id", "text"):
        at = F.try_variant_get("v", f"$.{name}", "variant")
        kind = F.schema_of_variant(at)
        error = F.when(at.isNull(), f"missing {name}").when(kind != "STRING", f"{name} must be string")
        part = d.select("ord", error.alias("error")).filter("error IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out


def validate_qrels(rows: DataFrame, qids: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """ord, error of TSV judgements; qids (qid) and doc_ids (doc_id) are the known ones, as strings."""
    head = rows.filter((F.col("ord") == 1) & (strip(F.col("line")) != "query-id\tcorpus-id\tscore")).select("ord", F.lit("invalid header").alias("error"))
    d = rows.filter("ord > 1").select("ord", F.split(strip(F.col("line")), "\t").alias("p"))
    shape = d.filter(F.size("p") != 3).select("ord", F.lit("expected 3 fields").alias("error"))
    d = d.filter(F.size("p") == 3).select("ord", F.get("p", F.lit(0)).alias("qid"), F.get("p", F.lit(1)).alias("doc_id"), F.get("p", F.lit(2)).alias("s"))
    no_q = d.join(qids.select("qid").distinct(), "qid", "left_anti").select("ord", F.lit("unknown query").alias("error"))
    no_d = d.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").select("ord", F.lit("unknown document").alias("error"))
    number = F.col("s").try_cast("int")
    score = F.when(number.isNull(), "score is no integer").when(~number.isin(0, 1), "score is not 0 or 1")
    scores = d.select("ord", score.alias("error")).filter("error IS NOT NULL")
    return head.unionByName(shape).unionByName(no_q).unionByName(no_d).unionByName(scores)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Files of predictions, each one JSON array; a task reads a file."""
    kind = "qid STRING, query STRING, answer STRING, contexts ARRAY<STRUCT<docid: STRING, text: STRING>>, retriever_scores MAP<STRING, DOUBLE>"
    return spark.read.schema(kind).option("multiLine", True).json(path)


def checksum(spark: SparkSession, path: str) -> DataFrame:
    """path, SHA-256 of each file of a folder, those below it too, or of one file. Files are dealt to tasks; those of more than WHOLE
    bytes are read as streams, in the filesystems of pyarrow."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.filter(F.col("length") <= WHOLE).select("path", F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > WHOLE).select("path")
    large = shipped(large).repartition("path").mapInArrow(_streamed, "path string, sha256 string")
    found = small.unionByName(large)
    if len(files.inputFiles()) > files.select("path").count():  # empty files have no row there
        at, empty = spark._jvm.org.apache.hadoop.fs.Path(path), []
        own = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
        while own.hasNext():
            status = own.next()
            if not status.getLen() and not status.getPath().getName().startswith(("_", ".")):
                empty.append((status.getPath().toString(),))
        found = found.unionByName(spark.createDataFrame(empty, "path string").withColumn("sha256", F.sha2(F.lit(b""), 256)))
    return found


def _streamed(batches):
    import hashlib

    import pyarrow as pa

    from .binary import _fs

    for b in batches:
        rows = []
        for path in b.column("path").to_pylist():
            own, (fs, at) = hashlib.sha256(), _fs(path)
            with fs.open_input_stream(at) as f:
                while piece := f.read(1 << 22):
                    own.update(piece)
            rows.append(own.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(rows, pa.string())], names=["path", "sha256"])


def packed(vectors: DataFrame) -> DataFrame:
    """vec_id, bytes of rows vec_id, embedding: little-endian float32."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = [np.asarray(v, "<f4").tobytes() for v in b.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(rows, pa.binary())], names=["vec_id", "bytes"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, bytes binary")


def unpacked(flat: DataFrame, dim: int) -> DataFrame:
    """vec_id, embedding of rows vec_id, bytes: dim little-endian float32 each."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            data = np.frombuffer(b"".join(b.column("bytes").to_pylist()), "<f4")
            cut = pa.array(np.arange(b.num_rows + 1) * dim, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.ListArray.from_arrays(cut, pa.array(data))], names=["vec_id", "embedding"])

    return flat.select("vec_id", "bytes").mapInArrow(run, "vec_id long, embedding array<float>")
