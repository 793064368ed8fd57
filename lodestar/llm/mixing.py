"""Mixing sources to target weights, with DataFrame functions only.

Every source gets a word target; a document is taken for all complete epochs
of its source, and a last, fractional epoch is drawn by Efraimidis-Spirakis
sampling: key = -ln(u) / weight, u a hash of the id, so reruns agree; sorted by
key within the source, prefix-summed up to what is left of the target. A long
document may stop the sum short; the gap is then filled likewise, in the same
order, from the documents left that fit it, until none fits. Each pass takes a document at least, and leaves a
gap smaller than one that it passed over, so gaps shrink fast. Rows that repeat an id go
together: a source is full where the next one's rows don't fit together.

The prefix sums are taken in two levels, over BUCKETS ranges of the key and then
inside the one range that holds the cut, so that a source with a third of all
rows never meets in one task. What is left is one row per source.

A null text has size 0; the null source is a source of its own, ordered last.
Repeated rows share their key and thus the decision; so do all rows of null ids. Texts of any length are counted whole. An empty table gives
none; other columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, materialise, table
from .quality_rules import WORD

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BUCKETS = 4096
SEED = "lodestar"
#: Stands for a null id where ids are compared.
_NO_ID = -(1 << 63)


def _size(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def _quality(size: Column, n_chars: Column) -> Column:
    """Sampling weight in {1/4, 1/2, 1}: short texts and odd word lengths count less."""
    mean = F.when(size > 0, n_chars / size).otherwise(0.0)
    return F.when(size >= 50, 1.0).otherwise(0.5) * F.when((mean >= 3) & (mean <= 15), 1.0).otherwise(0.5)


def _draw(doc_id: Column) -> Column:
    """Uniform in (0, 1): the first 52 bits of an MD5."""
    h = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def sizes(docs: DataFrame, *keep: Column) -> DataFrame:
    """keep, doc_id, source, size, key and bucket, the key's range."""
    d = docs.select(*keep, "doc_id", "source", _size(F.col("text")).alias("size"), F.length(F.coalesce("text", F.lit(""))).alias("_n"))
    d = d.withColumn("key", -F.ln(_draw(F.col("doc_id"))) / _quality(F.col("size"), F.col("_n")))
    bucket = F.least(F.floor((1 - F.exp(-0.6 * F.col("key"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    return d.withColumn("bucket", bucket).drop("_n")


def targets(src: DataFrame) -> DataFrame:
    """source, source_size -> also weight and target. One row per source meets in one task, no documents."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    d = src.withColumn("weight", F.element_at(F.lit(list(WEIGHTS)), (F.row_number().over(w) - 1) % len(WEIGHTS) + 1))
    d = d.withColumn("_r", MOST * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("_r", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(0))
    capped, weighed = F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    d = d.withColumns({
        "_o": F.row_number().over(Window.orderBy("_r", F.col("source").asc_nulls_last())),
        "_level": (SHARE * F.sum("source_size").over(all_rows) - capped) / (F.sum("weight").over(all_rows) - weighed),
    })
    # the level at the first source that does not reach its cap holds for it and all later ones
    first = F.min(F.when(F.col("_r") > F.col("_level"), F.struct("_o", "_level"))).over(all_rows)
    d = d.withColumn("_l", F.coalesce(first["_level"], F.lit(0.0))).withColumn("_f", F.coalesce(first["_o"], F.lit(2147483647)))
    target = F.when(F.col("_o") < F.col("_f"), (MOST * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("_l"))
    return d.select("source", "source_size", "weight", target.alias("target"))


def plan(sized: DataFrame) -> DataFrame:
    """One row per source: what decides for each of its documents.

    epochs complete ones, and in the last one what some of passes takes: a document of `most`
    words or fewer, up to the cut at (bucket, key, id).
    """
    by_source = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    t = targets(by_source)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    # sizes are whole numbers, so what is left may be one
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 1e-6)
    t = t.withColumn("epochs", epochs).withColumn("rest", rest)
    p = materialise(t.withColumn("passes", F.array().cast("array<struct<most:bigint,bucket:int,key:double,id:bigint>>")), "mix-targets")
    while (more := _with_pass(sized, p)) is not None:
        p = materialise(more, "mix-plan")
    return p


def _with_pass(sized: DataFrame, p: DataFrame) -> DataFrame | None:
    """p with one more pass, and what it leaves of rest; None if no document fits any more."""
    fits = _joined(sized, p).filter(~_selected() & (F.col("size") > 0) & (F.col("size") <= F.col("rest")))
    fits = fits.select("source", "bucket", "key", F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "size", "rest")
    b = fits.groupBy("source", "bucket").agg(F.sum("size").alias("bsize"), F.first("rest").alias("rest"))
    b = b.withColumn("upto", F.sum("bsize").over(Window.partitionBy("source").orderBy("bucket")))
    # the range that holds the cut is the first to reach beyond rest; without one, all is taken
    b = b.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("bsize")).alias("base")))).alias("cut"), F.max("upto").alias("all"))
    b = materialise(b.select(F.col("source").alias("c_source"), F.col("cut.bucket").alias("c_bucket"), F.coalesce("cut.base", "all").alias("base")), "mix-ranges")
    if b.isEmpty():
        return None
    at = fits.join(b, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bucket") == F.col("c_bucket")))
    upto = Window.partitionBy("source", "bucket").orderBy("key", "id").rangeBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("own", F.sum("size").over(upto)).filter(F.col("base") + F.col("own") <= F.col("rest"))
    at = at.groupBy(F.col("source").alias("a_source")).agg(F.max(F.struct("key", "id", "own")).alias("last"))
    p = p.join(b, F.col("source").eqNullSafe(F.col("c_source")), "left").join(at, F.col("source").eqNullSafe(F.col("a_source")), "left")
    one = F.struct(F.col("rest").alias("most"), F.coalesce("c_bucket", F.lit(BUCKETS)).alias("bucket"), F.col("last.key").alias("key"), F.col("last.id").alias("id"))
    taken = F.coalesce("base", F.lit(0)) + F.coalesce("last.own", F.lit(0))
    return p.select(
        "source", "source_size", "weight", "target", "epochs", F.when(taken > 0, F.col("rest") - taken).otherwise(F.lit(0)).alias("rest"),
        F.when(F.col("base").isNull(), F.col("passes")).otherwise(F.array_append("passes", one)).alias("passes"),
    )


def _selected() -> Column:
    """In the fractional epoch."""
    own = F.coalesce("doc_id", F.lit(_NO_ID))

    def taken(p: Column) -> Column:
        at_cut = (F.col("bucket") == p["bucket"]) & p["key"].isNotNull() & ((F.col("key") < p["key"]) | ((F.col("key") == p["key"]) & (own <= p["id"])))
        return (F.col("size") > 0) & (F.col("size") <= p["most"]) & ((F.col("bucket") < p["bucket"]) | at_cut)

    return F.exists("passes", taken)


def _joined(sized: DataFrame, p: DataFrame) -> DataFrame:
    """A broadcast where the number of sources is counted and small, else a join that Spark may split."""
    q = p.select(F.col("source").alias("p_source"), *[c for c in p.columns if c != "source"])
    if p.count() <= BROADCAST_ROWS:
        q = F.broadcast(q)
    return sized.join(q, F.col("source").eqNullSafe(F.col("p_source")), "left").drop("p_source")


def _times() -> Column:
    """How often the mix takes the document."""
    return F.col("epochs") + _selected().cast("int")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken."""
    sized = materialise(sizes(docs), "mix-sizes")
    d = _joined(sized, plan(sized)).withColumn("times", _times())
    return d.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus: the rows of docs, with their columns, as often as the mix takes them.

    Texts stay where they are: the plan has one row per source. A document of no words comes with
    complete epochs only.
    """
    sized = materialise(sizes(docs.select("doc_id", "source", "text")), "mix-sizes")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    boxed = boxed.select("_row", "_row.doc_id", "_row.source", "_row.text")
    d = _joined(sizes(boxed, F.col("_row")), plan(sized))
    return d.select(F.explode(F.array_repeat(F.col("_row"), _times())).alias("_row")).select("_row.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")




OP2_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         length(coalesce(text, '')) AS n,
         (('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), k AS (
  SELECT *, -ln(u) / (CASE WHEN size >= 50 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END
      * CASE WHEN size > 0 AND n / size >= 3 AND n / size <= 15 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, row_number() OVER (ORDER BY {MOST} * source_size / weight, source NULLS LAST) AS o,
         {MOST} * source_size / weight AS r,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum({MOST} * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lv
  FROM s WINDOW b AS (ORDER BY {MOST} * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT min(o) AS fo, arg_min(lv, o) AS fl FROM l WHERE r > lv),
t AS (
  SELECT source, source_size, CASE WHEN o < coalesce(fo, 2147483647) THEN ({MOST} * source_size)::DOUBLE ELSE weight * fl END AS target
  FROM l, f
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), g0 AS (
  SELECT k.*, source_size, target, epochs, floor(target - epochs * source_size + 1e-6::DOUBLE)::BIGINT AS rest, false AS sel
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
), g AS (
  SELECT 0 AS pass, doc_id, source, size, key, source_size, target, epochs, rest, sel FROM g0
  UNION ALL
  SELECT pass + 1, doc_id, source, size, key, source_size, target, epochs,
         CASE WHEN t > 0 THEN rest - t ELSE 0 END, sel OR (fits AND r <= rest)
  FROM (SELECT *, coalesce(max(CASE WHEN fits AND r <= rest THEN r END) OVER (PARTITION BY source), 0) AS t FROM (
    SELECT *, sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key, doc_id)::BIGINT AS r, count(*) FILTER (WHERE fits) OVER () AS n
    FROM (SELECT *, NOT sel AND size > 0 AND size <= rest AS fits FROM g)
  ) WHERE n > 0)
)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN sel THEN 1 ELSE 0 END))::BIGINT AS taken
FROM g WHERE pass = (SELECT max(pass) FROM g)
"""
