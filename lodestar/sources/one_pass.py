"""Files of JSON lines that are read once: numbered, validated and parsed by one scan, whose counts of errors come with it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.index import sized
from ..runtime import materialise
from . import text_files as L


@dataclass
class Scanned:
    """rows: ord, line errors, record errors, id and texts of each line that isn't blank; n, malformed and invalid count lines."""

    rows: DataFrame
    n: int
    malformed: int
    invalid: int

    @property
    def errors(self) -> DataFrame:
        """ord, error: of lines that are no JSON objects, or if there are none of records."""
        if self.malformed:
            return self.rows.select("ord", F.col("malformed").alias("error")).filter("error IS NOT NULL")
        return self.rows.select("ord", F.explode("invalid").alias("error"))


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """line, and its split and place: a split's lines follow each other in a task."""
    split = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")]
    return spark.read.text(path).select(F.col("value").alias("line"), *split).withColumn("_i", F.monotonically_increasing_id())


def _numbered(rows: DataFrame) -> DataFrame:
    """rows, a table that _placed made, with ord from 1 in the order of files; what was dropped must have left its number."""
    per = rows.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    per = per.select(F.col("_f").alias("_file"), F.col("_b").alias("_block"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    d = rows.join(sized(per), (F.col("_f") == F.col("_file")) & (F.col("_b") == F.col("_block")))
    return d.withColumn("ord", F.col("_before") + F.col("_i") - F.col("_first") + 1).drop("_f", "_b", "_i", "_file", "_block", "_first", "_before")


def _invalid(v: Column) -> Column:
    """The record errors of a parsed line: _id and text must be there and be strings."""
    out = []
    for name in ("_id", "text"):
        at = F.try_variant_get(v, f"$.{name}", "variant")
        out.append(F.when(at.isNull(), f"missing {name}").when(F.schema_of_variant(at) != "STRING", f"{name} must be string"))
    return F.when(v.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*out)))


def scan(spark: SparkSession, path: str, ids: tuple[str, ...] = L.DOC_IDS, texts: tuple[str, ...] = L.DOC_TEXTS, also: tuple[str, ...] = ("title",)) -> Scanned:
    """Read a file, or a folder's files, once. Everything else reads the columns that this pass leaves."""
    v = F.try_parse_json("line")
    names = dict.fromkeys(ids + texts + also)
    j = F.from_json("line", ", ".join(f"`{n}` STRING" for n in names) + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    whole = F.col("j").isNotNull() & F.col("j._bad").isNull() & (strip(F.col("line")) != "")
    some = F.trim("line") != ""
    malformed = F.when(some & v.isNull(), "invalid JSON").when(some & ~F.schema_of_variant(v).startswith("OBJECT"), "not an object")
    d = _placed(spark, path).withColumn("j", j).withColumn("j", F.when(whole, F.col("j").dropFields("_bad")))
    d = d.select("_f", "_b", "_i", some.alias("some"), malformed.alias("malformed"), F.when(some, _invalid(v)).alias("invalid"), "j")
    seen = Observation()
    counts = [F.count_if("some").alias("n"), F.count_if(F.col("malformed").isNotNull()).alias("malformed"), F.count_if(F.size("invalid") > 0).alias("invalid")]
    rows = _numbered(materialise(d.observe(seen, *counts), "scanned"))
    got = seen.get
    return Scanned(rows.filter("some").drop("some"), got["n"], got["malformed"], got["invalid"])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """ord, line, of one read of the file."""
    return _numbered(materialise(_placed(spark, path), "lines"))


def _first(names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.col(f"j.`{n}`"), F.lit("")) for n in names])


def corpus(of: Scanned) -> DataFrame:
    """doc_id, title, text of scan(path): as load_corpus has them."""
    d = of.rows.filter("j IS NOT NULL")
    name = F.coalesce(_first(L.DOC_IDS), F.concat(F.lit("doc_"), F.col("ord")))
    return L._last(d.select("ord", name.alias("doc_id"), F.col("j.title").alias("title"), F.coalesce(*[F.col(f"j.{n}") for n in L.DOC_TEXTS]).alias("text")), "doc_id")


def queries(of: Scanned) -> DataFrame:
    """qid, text of scan(path, QUERY_IDS, QUERY_TEXTS): as load_queries has them."""
    d = of.rows.filter("j IS NOT NULL")
    name = F.coalesce(_first(L.QUERY_IDS), F.concat(F.lit("query_"), F.col("ord")))
    return L._last(d.select("ord", name.alias("qid"), strip(_first(L.QUERY_TEXTS)).alias("text")), "qid")
