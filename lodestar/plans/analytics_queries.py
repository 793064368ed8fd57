"""Queries over vectors, conversations, the query log, and files in the making."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cells as X
from ..operators import docstore as D
from ..operators import metrics as M
from ..operators import monitoring as N
from ..operators import scoring as S
from ..operators import vectors as V
from ..runtime import materialise, table
from ..sources import text_files as L
from . import report
from .retrieval_queries import PUNCT_SQL, docs, queries

#: Vectors whose id this divides are the queries; all vectors are searched.
EVERY = 50


def vectors(spark, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))


def _asked(c: DataFrame) -> DataFrame:
    return c.filter(F.col("doc_id") % EVERY == 0).withColumnRenamed("doc_id", "qid")


def dense_corpus(spark, d: str) -> DataFrame:
    return vectors(spark, d).withColumn("scale", F.lit(1.0))


def int8_corpus(spark, d: str) -> DataFrame:
    q, scale = V.quantise_symmetric(F.col("v"))
    return vectors(spark, d).select("doc_id", q.alias("v"), (scale / 127).alias("scale"))


def _dense(spark, d: str, k: int, least: float | None = None) -> DataFrame:
    c = dense_corpus(spark, d)
    return X.search(c, _asked(c), k, least)


def _int8(spark, d: str, k: int) -> DataFrame:
    c = int8_corpus(spark, d)
    return X.search(c, _asked(c), k)


def dense_topk(spark, d):
    return _dense(spark, d, 10)


def vector_search_min(spark, d):
    return _dense(spark, d, 10, 0.5)


def int8_topk(spark, d):
    return _int8(spark, d, 10)


def topk(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", "value").filter("value IS NOT NULL")
    return S.top_k(e, 10, "event_type", score="value", id_="event_id")


def global_topk(spark, d):
    e = table(spark, d, "events").select("event_id", "value").filter("value IS NOT NULL")
    return e.orderBy(F.desc("value"), "event_id").limit(100)


def approx_topk(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("score")).filter("score IS NOT NULL")
    return S.approx_top_k(e, 100)


def _joined(q) -> F.Column:
    return F.array_join(F.transform(q, lambda x: x.cast("string")), ",")


def quantize_symmetric(spark, d):
    q, s = V.quantise_symmetric(F.col("v"))
    return vectors(spark, d).select("doc_id", _joined(q).alias("q"), F.round(s, 9).alias("scale"))


def quantize_symmetric_trunc(spark, d):
    q, s = V.quantise_symmetric(F.col("v"), "truncate")
    return vectors(spark, d).select("doc_id", _joined(q).alias("q"), F.round(s, 9).alias("scale"))


def quantize_asymmetric(spark, d):
    q, s, z = V.quantise_asymmetric(F.col("v"))
    return vectors(spark, d).select("doc_id", _joined(q).alias("q"), F.round(s, 9).alias("scale"), F.round(z, 9).alias("zero_point"))


def quantize_asymmetric_trunc(spark, d):
    q, s, z = V.quantise_asymmetric(F.col("v"), "truncate")
    return vectors(spark, d).select("doc_id", _joined(q).alias("q"), F.round(s, 9).alias("scale"), F.round(z, 9).alias("zero_point"))


def _both_ways(spark, d: str) -> DataFrame:
    q, s = V.quantise_symmetric(F.col("v"), "truncate")
    return vectors(spark, d).select("doc_id", "v", q.alias("q"), s.alias("s")).select("*", V.dequantise(F.col("q"), F.col("s")).alias("r"))


def dequantize(spark, d):
    r = _both_ways(spark, d).select("doc_id", F.posexplode("r").alias("i", "x"))
    return r.select("doc_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def quantization_error(spark, d):
    r = _both_ways(spark, d)
    diff = F.zip_with(V.doubles(F.col("v")), F.col("r"), lambda a, b: a - b)
    r = r.select(V.dot(diff, diff).alias("se"), F.aggregate(diff, F.lit(0.0), lambda a, x: a + F.abs(x)).alias("ae"), F.size("v").alias("n"), (1 - V.cosine(F.col("v"), F.col("r"))).alias("ce"))
    return r.agg(F.round(F.sum("se") / F.sum("n"), 12).alias("mse"), F.round(F.sum("ae") / F.sum("n"), 9).alias("mae"), F.round(F.avg("ce"), 9).alias("cosine_error"))


def _neighbours(spark, d: str) -> DataFrame:
    """Each vector with the next one, exact and quantised."""
    c = _both_ways(spark, d)
    b = c.select((F.col("doc_id") - 1).alias("doc_id"), F.col("v").alias("v2"), F.col("q").alias("q2"), F.col("s").alias("s2"))
    return c.join(b, "doc_id")


def cosine_int8(spark, d):
    return _neighbours(spark, d).select("doc_id", F.round(V.cosine(F.col("q"), F.col("q2")), 6).alias("cosine"))


def score_corr(spark, d):
    n = _neighbours(spark, d).select(V.dot(F.col("v"), F.col("v2")).alias("a"), (V.dot(F.col("q"), F.col("q2")) * F.col("s") * F.col("s2")).alias("b"))
    return n.agg(F.round(F.corr("a", "b"), 6).alias("correlation"), F.count(F.lit(1)).alias("n_pairs"))


def rank_overlap(spark, d):
    a, b = materialise(_int8(spark, d, 50), "int8"), materialise(_dense(spark, d, 50), "dense")
    out = None
    for k in (1, 5, 10, 20, 50):
        part = M.rank_agreement(a, b, k).select("qid", F.lit(k).cast("long").alias("k"), "overlap")
        out = part if out is None else out.unionByName(part)
    return out


def rank_spearman(spark, d):
    return M.rank_correlation(_int8(spark, d, 100), _dense(spark, d, 100))


def pairs(spark, d: str) -> DataFrame:
    """A user's turn stands for the prediction, the assistant's next one for the reference."""
    t = table(spark, d, "conversations")
    a = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    return t.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("pred")).join(a, ["conv_id", "turn"])


def rouge_n(spark, d):
    p, out = pairs(spark, d), None
    for n in (1, 2):
        part = M.rouge_n(p, n, "conv_id", "turn").withColumn("n", F.lit(n).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def rouge_l(spark, d):
    return M.rouge_l(pairs(spark, d), "conv_id", "turn")


def bleu(spark, d):
    return M.bleu(pairs(spark, d), "conv_id", "turn")


def gen_eval(spark, d):
    p = materialise(pairs(spark, d).withColumn("contexts", F.array("ref")), "pairs")
    asked = table(spark, d, "conversations").filter("role = 'user'").agg(F.count(F.lit(1)).alias("n_user"))
    m = report.means(p, "conv_id", "turn").withColumnRenamed("n", "n_pairs")
    return m.crossJoin(asked).select("rouge1", "rouge2", F.col("rougeL").alias("rouge_l"), "bleu", "faithfulness", "n_pairs", (F.col("n_user") - F.col("n_pairs")).alias("n_missing"))


def log(spark, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n = F.get_json_object("props", "$.k").cast("long")
    return e.select("ts", F.col("event_id").alias("query_id"), F.col("value").alias("latency_ms"), n.alias("n_results"), (F.col("event_type") == "error").alias("failed"), F.col("event_type").alias("method"), "user_id")


def system_stats(spark, d):
    return N.system_stats(log(spark, d))


def rolling_latency(spark, d):
    return N.rolling_latency(log(spark, d))


def running_latency(spark, d):
    return N.running_latency(log(spark, d))


def latency_summary(spark, d):
    return N.latency_summary(log(spark, d))


def latency_percentiles(spark, d):
    return N.latency_percentiles(log(spark, d), "method")


def timing_stats(spark, d):
    return N.timing_stats(log(spark, d), "method")


def speedup(spark, d):
    return N.speedup(log(spark, d), "click")


def best_method(spark, d):
    return N.best_method(log(spark, d), "user_id")


def grade(spark, d):
    m = log(spark, d).groupBy("method").agg(F.avg("latency_ms").alias("m"))
    all_ = log(spark, d).agg(F.avg("latency_ms").alias("target"))
    return m.join(F.broadcast(all_)).select("method", N.grade(F.col("m"), F.col("target")).alias("grade"))


def raw_lines(spark, d: str) -> DataFrame:
    """JSON lines as files bring them: changing field names, blank and broken lines, ids that come again."""
    t = docs(spark, d).withColumn("k", F.col("doc_id") % 9)
    name = F.when(F.col("k") == 7, F.floor(F.col("doc_id") / 2).cast("string")).otherwise(F.col("doc_id").cast("string"))
    j = F.when(F.col("k") == 0, F.to_json(F.struct(name.alias("id"), F.col("text").alias("content"))))
    j = j.when(F.col("k") == 1, F.to_json(F.struct(name.alias("docid"), F.col("text").alias("body"))))
    j = j.when(F.col("k") == 2, F.to_json(F.struct(F.lit("").alias("id"), F.col("text").alias("text"))))
    j = j.when(F.col("k") == 3, F.substring(F.to_json(F.struct(name.alias("_id"), F.col("text").alias("text"))), 1, 20))
    j = j.when(F.col("k") == 4, F.lit("  ")).when(F.col("k") == 5, F.to_json(F.struct(F.col("doc_id").alias("_id"), F.lit("").alias("text"))))
    j = j.otherwise(F.to_json(F.struct(name.alias("_id"), F.lit("A title").alias("title"), F.col("text").alias("text"))))
    return t.select((F.col("doc_id") + 1).alias("ord"), j.alias("line"))


def load_corpus(spark, d):
    return L.load_corpus(raw_lines(spark, d))


def load_queries(spark, d):
    q = queries(spark, d).withColumn("k", F.col("qid") % 4)
    j = F.when(F.col("k") == 0, F.to_json(F.struct(F.col("qid").cast("string").alias("qid"), F.col("text").alias("question"))))
    j = j.when(F.col("k") == 1, F.to_json(F.struct(F.col("text").alias("query")))).when(F.col("k") == 2, F.lit("{"))
    j = j.otherwise(F.to_json(F.struct(F.col("qid").cast("string").alias("_id"), F.concat(F.lit("  "), F.col("text")).alias("text"))))
    return L.load_queries(q.select((F.col("qid") + 1).alias("ord"), j.alias("line")))


def qrels_lines(spark, d: str) -> DataFrame:
    t = table(spark, d, "labels").withColumn("k", F.col("doc_id") % 6)
    f = [(F.col("doc_id") % 50).cast("string"), (2 * F.col("doc_id")).cast("string"), F.col("quality").cast("string")]
    line = F.when(F.col("k") == 0, F.concat_ws(" ", *f)).when(F.col("k") == 1, F.concat(F.concat_ws("\t", *f), F.lit(".0"))).when(F.col("k") == 2, F.concat_ws("\t", *f[:2]))
    line = line.when(F.col("k") == 3, F.concat_ws("\t", *f[:2], F.lit("bad"))).otherwise(F.concat_ws("\t", *f))
    rows = t.select((F.col("doc_id") + 2).alias("ord"), line.alias("line"))
    head = spark.createDataFrame([(1, "query-id\tcorpus-id\tscore")], "ord long, line string")
    return head.unionByName(rows)


def load_qrels(spark, d):
    return L.load_qrels(qrels_lines(spark, d))


def validate_qrels(spark, d):
    q = queries(spark, d).select(F.col("qid").cast("string").alias("qid"))
    t = docs(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"))
    return L.validate_qrels(qrels_lines(spark, d), q, t)


def json_lines(spark, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "props").withColumn("k", F.col("event_id") % 8)
    n = F.col("event_id").cast("string")
    line = F.when(F.col("k") == 0, F.lit("{\"a\": ")).when(F.col("k") == 1, F.lit("[1]"))
    line = line.when(F.col("k") == 2, F.concat(F.lit('{"_id": '), n, F.lit(', "text": "x"}'))).when(F.col("k") == 3, F.concat(F.lit('{"_id": "'), n, F.lit('", "text": 5}')))
    line = line.when(F.col("k") == 4, F.concat(F.lit('{"_id": "'), n, F.lit('", "text": "x"}'))).otherwise(F.col("props"))
    return e.select(F.col("event_id").alias("ord"), line.alias("line"))


def validate_jsonl(spark, d):
    return L.validate_jsonl(json_lines(spark, d))


def validate_docs(spark, d):
    return L.validate_records(json_lines(spark, d))


def corpus_error_classes(spark, d):
    r = raw_lines(spark, d).select(L.error_class(F.col("line")).alias("class"))
    return r.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def corpus_valid(spark, d):
    return docs(spark, d).filter(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", F.length("text").cast("long").alias("n_chars"))


def corpus_stats(spark, d):
    return D.corpus_stats(docs(spark, d))


def dataset_stats(spark, d):
    rel = table(spark, d, "labels").select((F.col("doc_id") * 3).alias("doc_id"), (F.col("doc_id") % 97).alias("qid"))
    return D.dataset_stats(docs(spark, d), queries(spark, d), rel)


def docstore_upsert(spark, d):
    t = docs(spark, d)
    new = t.select((F.col("doc_id") + 500).alias("doc_id"), F.concat("text", F.lit("!")).alias("text"))
    return D.upsert(t, new).select("doc_id", F.md5("text").alias("text_md5"))


def docstore_stats(spark, d):
    return D.store_stats(docs(spark, d))


def binary_corpus_stats(spark, d):
    return D.byte_stats(docs(spark, d))


def _wanted(spark, d: str) -> DataFrame:
    return table(spark, d, "labels").select((F.col("doc_id") * 2).alias("doc_id"), F.col("doc_id").alias("pos"))


def get_documents(spark, d):
    return D.get_documents(docs(spark, d), _wanted(spark, d))


def contains_doc(spark, d):
    return D.contains(docs(spark, d), _wanted(spark, d))


def doc_batch(spark, d):
    return D.batch(docs(spark, d), 95, 100)


_E = "e AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings)"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"
_SYM = f"{_E}, m AS (SELECT *, greatest(list_max(list_transform(v, lambda x: abs(x))), 1e-8::DOUBLE) AS s FROM e), q AS (SELECT doc_id, v, s, list_transform(v, lambda x: round_even(x / s * 127, 0)::INT) AS q FROM m)"
_SYMT = f"{_E}, m AS (SELECT *, CASE WHEN list_max(list_transform(v, lambda x: abs(x))) > 0 THEN list_max(list_transform(v, lambda x: abs(x))) / 127 ELSE 1 END AS s FROM e), q AS (SELECT doc_id, v, s, list_transform(v, lambda x: least(127, greatest(-127, trunc(x / s)::INT))) AS q FROM m)"


def _asym(f: str) -> str:
    return f"""WITH {_E}, m AS (SELECT *, list_min(v) AS z, CASE WHEN list_max(v) > list_min(v) THEN (list_max(v) - list_min(v)) / 255 ELSE 1 END AS s FROM e)
SELECT doc_id, array_to_string(list_transform(v, lambda x: least(255, greatest(0, {f.format('(x - z) / s')}::INT))), ',') AS q, round(s, 9) AS scale, round(z, 9) AS zero_point FROM m"""


def _top(source: str, score: str, k: int, name: str = "run") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT a.doc_id AS qid, b.doc_id AS doc_id, round({score}, 6) AS score FROM {source} a, {source} b WHERE a.doc_id % {EVERY} = 0)) WHERE rank <= {k})"""


_DENSE = _DOT.format("a.v", "b.v")
_INT8 = f"{_DOT.format('a.q', 'b.q')} * (a.s / 127) * (b.s / 127)"
_R = "r AS (SELECT *, list_transform(q, lambda x: x * s) AS r FROM q)"
_COS = f"CASE WHEN sqrt({_DOT.format('{0}', '{0}')}) * sqrt({_DOT.format('{1}', '{1}')}) > 0 THEN {_DOT.format('{0}', '{1}')} / (sqrt({_DOT.format('{0}', '{0}')}) * sqrt({_DOT.format('{1}', '{1}')})) ELSE 0 END"

_PAIRS = rf"""pairs AS (
  SELECT u.conv_id, u.turn, list_filter(string_split(trim(regexp_replace(translate(lower(u.text), {PUNCT_SQL}, ''), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS p,
         list_filter(string_split(trim(regexp_replace(translate(lower(a.text), {PUNCT_SQL}, ''), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS r
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def _grams(n: int) -> str:
    g = lambda c: f"list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))"
    return f"""g{n} AS (SELECT conv_id, turn, {g('p')} AS pg, {g('r')} AS rg, len(p) AS np, len(r) AS nr FROM pairs),
h{n} AS (SELECT conv_id, turn, sum(least(a.c, b.c)) AS hits FROM
  (SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, unnest(pg) AS g FROM g{n}) GROUP BY ALL) a
  JOIN (SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, unnest(rg) AS g FROM g{n}) GROUP BY ALL) b USING (conv_id, turn, g) GROUP BY ALL),
o{n} AS (SELECT conv_id, turn, np, nr, len(pg) AS pn, len(rg) AS rn, coalesce(hits, 0)::BIGINT AS hits FROM g{n} LEFT JOIN h{n} USING (conv_id, turn))"""


def _prf(hits: str, a: str, b: str) -> str:
    p, r = f"CASE WHEN {a} > 0 THEN {hits} / {a} ELSE 0 END", f"CASE WHEN {b} > 0 THEN {hits} / {b} ELSE 0 END"
    return f"round({p}, 6) AS precision, round({r}, 6) AS recall, round(CASE WHEN {hits} > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0 END, 6) AS f1"


_LCS = """l(conv_id, turn, i, row) AS (
  SELECT conv_id, turn, 0, list_transform(r, lambda x: 0) FROM pairs
  UNION ALL SELECT conv_id, turn, i + 1, list_transform(range(1, len(c) + 1), lambda k: list_max(c[1:k])) FROM (
    SELECT l.conv_id, l.turn, i, list_transform(r, lambda x, k: CASE WHEN x = p[i + 1] THEN coalesce(CASE WHEN k > 1 THEN row[k - 1] END, 0) + 1 ELSE row[k] END) AS c
    FROM l JOIN pairs USING (conv_id, turn) WHERE i < len(p))
), z AS (SELECT conv_id, turn, len(p) AS np, len(r) AS nr, coalesce(row[-1], 0) AS hits FROM l JOIN pairs USING (conv_id, turn) WHERE i = len(p))"""

_BLEU = f"""{_PAIRS}, {_grams(1)}, {_grams(2)}, {_grams(3)}, {_grams(4)},
bl AS (SELECT conv_id, turn, round(CASE WHEN o1.hits > 0 AND o2.hits > 0 AND o3.hits > 0 AND o4.hits > 0
  THEN least(1.0::DOUBLE, o1.np / o1.nr) * exp((ln(o1.hits / o1.pn) + ln(o2.hits / o2.pn) + ln(o3.hits / o3.pn) + ln(o4.hits / o4.pn)) / 4) ELSE 0 END, 6) AS bleu
  FROM o1 JOIN o2 USING (conv_id, turn) JOIN o3 USING (conv_id, turn) JOIN o4 USING (conv_id, turn))"""

_LOG = "lg AS (SELECT ts, event_id AS query_id, value AS latency_ms, json_extract_string(props, '$.k')::BIGINT AS n_results, event_type = 'error' AS failed, event_type AS method, user_id FROM events)"
_OK = f"{_LOG}, ok AS (SELECT * FROM lg WHERE NOT failed)"


def _exclusive(p: float, least: int) -> str:
    at, j = f"{p}::DOUBLE * (n + 1)", f"least(greatest(floor({p}::DOUBLE * (n + 1)), 1), greatest(n - 1, 1))::INT"
    return f"round(CASE WHEN n >= {least} THEN v[{j}] + ({at} - {j}) * (v[{j} + 1] - v[{j}]) ELSE v[-1] END, 6)"


_NAME = "CASE WHEN doc_id % 9 = 7 THEN (doc_id // 2)::VARCHAR ELSE doc_id::VARCHAR END"
_LINES = f"""ln AS (SELECT doc_id + 1 AS ord, CASE doc_id % 9 WHEN 0 THEN json_object('id', {_NAME}, 'content', text)::VARCHAR WHEN 1 THEN json_object('docid', {_NAME}, 'body', text)::VARCHAR
  WHEN 2 THEN json_object('id', '', 'text', text)::VARCHAR WHEN 3 THEN '{{"' WHEN 4 THEN '  ' WHEN 5 THEN json_object('_id', doc_id, 'text', '')::VARCHAR
  ELSE json_object('_id', {_NAME}, 'title', 'A title', 'text', text)::VARCHAR END AS line FROM documents),
js AS (SELECT ord, line, try_cast(line AS JSON) AS j FROM ln WHERE trim(line) <> '')"""
_QL = """ql AS (SELECT doc_id + 2 AS ord, CASE doc_id % 6 WHEN 0 THEN concat_ws(' ', doc_id % 50, 2 * doc_id, quality) WHEN 1 THEN concat_ws(chr(9), doc_id % 50, 2 * doc_id, quality || '.0')
  WHEN 2 THEN concat_ws(chr(9), doc_id % 50, 2 * doc_id) WHEN 3 THEN concat_ws(chr(9), doc_id % 50, 2 * doc_id, 'bad') ELSE concat_ws(chr(9), doc_id % 50, 2 * doc_id, quality) END AS line FROM labels)"""
_JL = """jl AS (SELECT event_id AS ord, CASE event_id % 8 WHEN 0 THEN '{"a": ' WHEN 1 THEN '[1]' WHEN 2 THEN '{"_id": ' || event_id || ', "text": "x"}'
  WHEN 3 THEN '{"_id": "' || event_id || '", "text": 5}' WHEN 4 THEN '{"_id": "' || event_id || '", "text": "x"}' ELSE props::VARCHAR END AS line FROM events),
jv AS (SELECT ord, try_cast(line AS JSON) AS v FROM jl)"""


def _field(names: tuple[str, ...], filled: bool = False) -> str:
    return "coalesce(" + ", ".join(f"nullif(json_extract_string(j, '$.{n}'), '')" if filled else f"json_extract_string(j, '$.{n}')" for n in names) + ")"


QUERIES = {
    f.__name__: f
    for f in (
        dense_topk, vector_search_min, int8_topk, topk, global_topk, approx_topk, quantize_symmetric, quantize_symmetric_trunc, quantize_asymmetric,
        quantize_asymmetric_trunc, dequantize, quantization_error, cosine_int8, score_corr, rank_overlap, rank_spearman, rouge_n, rouge_l, bleu, gen_eval,
        system_stats, rolling_latency, running_latency, latency_summary, latency_percentiles, timing_stats, speedup, best_method, grade, load_corpus,
        load_queries, load_qrels, validate_qrels, validate_jsonl, validate_docs, corpus_error_classes, corpus_valid, corpus_stats, dataset_stats,
        docstore_upsert, docstore_stats, binary_corpus_stats, get_documents, contains_doc, doc_batch,
    )
}

ORACLE_SQL = {
    "dense_topk": f"WITH {_E}, {_top('e', _DENSE, 10)} SELECT qid, doc_id, score, rank FROM run",
    "vector_search_min": f"WITH {_E}, {_top('e', _DENSE, 10)} SELECT qid, doc_id, score, rank FROM run WHERE score >= 0.5",
    "int8_topk": f"WITH {_SYM}, {_top('q', _INT8, 10)} SELECT qid, doc_id, score, rank FROM run",
    "approx_topk": "SELECT event_id AS id, value AS score FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 100",
    "topk": "SELECT * FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events WHERE value IS NOT NULL) WHERE rank <= 10",
    "global_topk": "SELECT event_id, value FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 100",
    "quantize_symmetric": f"WITH {_SYM} SELECT doc_id, array_to_string(q, ',') AS q, round(s, 9) AS scale FROM q",
    "quantize_symmetric_trunc": f"WITH {_SYMT} SELECT doc_id, array_to_string(q, ',') AS q, round(s, 9) AS scale FROM q",
    "quantize_asymmetric": _asym("round_even({}, 0)"),
    "quantize_asymmetric_trunc": _asym("trunc({})"),
    "dequantize": f"WITH {_SYMT}, {_R} SELECT doc_id, unnest(range(0, len(r)))::BIGINT AS i, round(unnest(r), 6) AS x FROM r",
    "quantization_error": f"""WITH {_SYMT}, {_R}, f AS (SELECT *, list_transform(list_zip(v, r), lambda z: z[1] - z[2]) AS f FROM r)
SELECT round(sum({_DOT.format('f', 'f')}) / sum(len(v)), 12) AS mse, round(sum(list_sum(list_transform(f, lambda x: abs(x)))) / sum(len(v)), 9) AS mae, round(avg(1 - {_COS.format('v', 'r')}), 9) AS cosine_error FROM f""",
    "cosine_int8": f"WITH {_SYMT}, c AS (SELECT doc_id, list_transform(q, lambda x: x::DOUBLE) AS q FROM q) SELECT a.doc_id, round({_COS.format('a.q', 'b.q')}, 6) AS cosine FROM c a JOIN c b ON b.doc_id = a.doc_id + 1",
    "score_corr": f"WITH {_SYMT} SELECT round(corr({_DENSE}, {_DOT.format('a.q', 'b.q')} * a.s * b.s), 6) AS correlation, count(*) AS n_pairs FROM q a JOIN q b ON b.doc_id = a.doc_id + 1",
    "rank_overlap": f"""WITH {_SYM}, {_top('q', _INT8, 50, 'ra')}, {_top('q', _DENSE, 50, 'rb')}, k AS (SELECT unnest([1, 5, 10, 20, 50])::BIGINT AS k)
SELECT q.qid, k, round(count(x.doc_id) / k, 6) AS overlap FROM (SELECT DISTINCT qid FROM ra) q CROSS JOIN k
LEFT JOIN (SELECT ra.qid, ra.doc_id, greatest(ra.rank, rb.rank) AS need FROM ra JOIN rb USING (qid, doc_id)) x ON x.qid = q.qid AND x.need <= k GROUP BY q.qid, k""",
    "rank_spearman": f"WITH {_SYM}, {_top('q', _INT8, 100, 'ra')}, {_top('q', _DENSE, 100, 'rb')} SELECT qid, count(*) AS n_common, round(corr(ra.rank, rb.rank), 6) AS spearman FROM ra JOIN rb USING (qid, doc_id) GROUP BY qid HAVING count(*) > 10",
    "rouge_n": f"WITH {_PAIRS}, {_grams(1)}, {_grams(2)} SELECT conv_id, turn, {_prf('hits', 'pn', 'rn')}, 1::BIGINT AS n FROM o1 UNION ALL SELECT conv_id, turn, {_prf('hits', 'pn', 'rn')}, 2::BIGINT AS n FROM o2",
    "rouge_l": f"WITH RECURSIVE {_PAIRS}, {_LCS} SELECT conv_id, turn, {_prf('hits', 'np', 'nr')} FROM z",
    "bleu": f"WITH {_BLEU} SELECT conv_id, turn, bleu FROM bl",
    "gen_eval": f"""WITH RECURSIVE {_BLEU}, {_LCS}, r1 AS (SELECT {_prf('hits', 'pn', 'rn')} FROM o1), r2 AS (SELECT {_prf('hits', 'pn', 'rn')} FROM o2), rl AS (SELECT {_prf('hits', 'np', 'nr')} FROM z),
fa AS (SELECT round(CASE WHEN len(p) > 0 THEN least(1.0::DOUBLE, len(list_intersect(list_distinct(p), r)) / len(list_distinct(p))::DOUBLE) ELSE 0 END, 6) AS f FROM pairs)
SELECT (SELECT round(avg(f1), 6) FROM r1) AS rouge1, (SELECT round(avg(f1), 6) FROM r2) AS rouge2, (SELECT round(avg(f1), 6) FROM rl) AS rouge_l, (SELECT round(avg(bleu), 6) FROM bl) AS bleu,
  (SELECT round(avg(f), 6) FROM fa) AS faithfulness, (SELECT count(*) FROM pairs) AS n_pairs, (SELECT count(*) FROM conversations WHERE role = 'user') - (SELECT count(*) FROM pairs) AS n_missing""",
    "system_stats": f"WITH {_LOG} SELECT count(*) AS total, count(*) FILTER (WHERE failed) AS failed, round(count(*) FILTER (WHERE NOT failed) / count(*), 6) AS success_rate, round(avg(n_results) FILTER (WHERE NOT failed), 6) AS avg_results, min(latency_ms) FILTER (WHERE NOT failed) AS min_ms, max(latency_ms) FILTER (WHERE NOT failed) AS max_ms FROM lg",
    "rolling_latency": f"WITH {_OK} SELECT query_id, round(avg(latency_ms) OVER (ORDER BY ts, query_id ROWS BETWEEN {N.ROLLING - 1} PRECEDING AND CURRENT ROW), 9) AS rolling_ms FROM ok",
    "running_latency": f"WITH {_OK} SELECT query_id, count(*) OVER w AS successes, min(latency_ms) OVER w AS min_ms, max(latency_ms) OVER w AS max_ms FROM ok WINDOW w AS (ORDER BY ts, query_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "latency_summary": f"""WITH {_OK}, s AS (SELECT count(*) AS n, list(latency_ms ORDER BY latency_ms) AS v, round(avg(latency_ms), 6) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 6) AS median_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, round(stddev_samp(latency_ms), 6) AS std_ms FROM ok)
SELECT n, (SELECT count(*) FROM lg WHERE failed) AS n_failed, mean_ms, median_ms, min_ms, max_ms, std_ms, {_exclusive(0.95, 20)} AS p95_ms, {_exclusive(0.99, 100)} AS p99_ms FROM s""",
    "latency_percentiles": f"WITH {_LOG} SELECT method, round(avg(latency_ms), 2) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 2) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 2) AS p95_ms FROM lg GROUP BY method",
    "timing_stats": f"WITH {_LOG} SELECT method, round(avg(latency_ms), 6) AS mean_ms, round(stddev_samp(latency_ms), 6) AS std_sample, round(stddev_pop(latency_ms), 6) AS std_population, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms FROM lg GROUP BY method",
    "speedup": f"WITH {_LOG}, m AS (SELECT method, quantile_cont(latency_ms, 0.5) AS m FROM lg GROUP BY method) SELECT method, round(m, 6) AS median_ms, round((SELECT m FROM m WHERE method = 'click') / m, 6) AS speedup FROM m",
    "best_method": f"WITH {_LOG}, m AS (SELECT user_id, method, round(avg(latency_ms), 6) AS mean_ms FROM lg GROUP BY ALL) SELECT user_id, method, mean_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mean_ms, method) AS i FROM m) WHERE i = 1",
    "grade": f"WITH {_LOG}, m AS (SELECT method, avg(latency_ms) / (SELECT avg(latency_ms) FROM lg) AS r FROM lg GROUP BY method) SELECT method, CASE WHEN r >= 1.1 THEN 'A+' WHEN r >= 1 THEN 'A' WHEN r >= 0.9 THEN 'B' WHEN r >= 0.75 THEN 'C' WHEN r >= 0.5 THEN 'D' ELSE 'F' END AS grade FROM m",
    "load_corpus": f"""WITH {_LINES}, c AS (SELECT ord, coalesce({_field(L.DOC_IDS, True)}, 'doc_' || ord) AS doc_id, json_extract_string(j, '$.title') AS title, {_field(L.DOC_TEXTS)} AS text FROM js WHERE j IS NOT NULL)
SELECT doc_id, title, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord DESC) AS i FROM c) WHERE i = 1""",
    "load_queries": r"SELECT CASE item_id % 4 WHEN 1 THEN 'query_' || (item_id + 1) ELSE item_id::VARCHAR END AS qid, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM benchmark WHERE item_id % 4 <> 2",
    "load_qrels": f"""WITH {_QL}, f AS (SELECT ord, CASE WHEN contains(line, chr(9)) THEN string_split(line, chr(9)) ELSE string_split(line, ' ') END AS p FROM ql)
SELECT p[1] AS qid, p[2] AS doc_id, trunc(try_cast(p[3] AS DOUBLE))::INT AS rel FROM f WHERE len(p) >= 3 AND try_cast(p[3] AS DOUBLE) IS NOT NULL""",
    "validate_qrels": f"""WITH {_QL}, f AS (SELECT ord, string_split(line, chr(9)) AS p FROM ql), g AS (SELECT ord, p[1] AS qid, p[2] AS doc_id, p[3] AS s FROM f WHERE len(p) = 3)
SELECT ord, 'expected 3 fields' AS error FROM f WHERE len(p) <> 3
UNION ALL SELECT ord, 'unknown query' FROM g WHERE qid NOT IN (SELECT item_id::VARCHAR FROM benchmark)
UNION ALL SELECT ord, 'unknown document' FROM g WHERE doc_id NOT IN (SELECT doc_id::VARCHAR FROM documents)
UNION ALL SELECT ord, CASE WHEN NOT regexp_full_match(s, '[+-]?[0-9]+') THEN 'score is no integer' ELSE 'score is not 0 or 1' END FROM g WHERE NOT regexp_full_match(s, '[+-]?[0-9]+') OR s NOT IN ('0', '1')""",
    "validate_jsonl": f"WITH {_JL} SELECT ord, CASE WHEN v IS NULL THEN 'invalid JSON' ELSE 'not an object' END AS error FROM jv WHERE v IS NULL OR json_type(v) <> 'OBJECT'",
    "validate_docs": f"""WITH {_JL}, n AS (SELECT ord, v, unnest(['_id', 'text']) AS name FROM jv WHERE v IS NOT NULL), k AS (SELECT ord, name, json_type(v, '$.' || name) AS kind FROM n)
SELECT ord, CASE WHEN kind IS NULL THEN 'missing ' || name ELSE name || ' must be string' END AS error FROM k WHERE kind IS NULL OR kind <> 'VARCHAR'""",
    "corpus_error_classes": "SELECT CASE WHEN doc_id % 9 IN (3, 4) THEN 'json' WHEN doc_id % 9 IN (0, 1, 2, 5) THEN 'validation' WHEN coalesce(text, '') = '' THEN 'validation' ELSE 'ok' END AS class, count(*) AS n FROM documents GROUP BY 1",
    "corpus_valid": "SELECT doc_id, length(text)::BIGINT AS n_chars FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0",
    "corpus_stats": r"WITH c AS (SELECT doc_id IS NOT NULL AND coalesce(length(text), 0) > 0 AS ok, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS n FROM documents) SELECT count(*) AS n_docs, count(*) FILTER (WHERE ok) AS n_valid, count(*) FILTER (WHERE NOT ok) AS n_invalid, sum(CASE WHEN ok THEN n ELSE 0 END)::BIGINT AS n_tokens, round(sum(CASE WHEN ok THEN n ELSE 0 END) / count(*) FILTER (WHERE ok), 6) AS avg_length FROM c",
    "dataset_stats": r"""WITH r AS (SELECT doc_id * 3 AS doc_id, doc_id % 97 AS qid FROM labels), t AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '\S+') AS w FROM documents)
SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT round(avg(len(w)), 6) FROM t) AS avg_doc_length, (SELECT count(*) FROM benchmark) AS n_queries,
  (SELECT round(avg(len(regexp_extract_all(text, '\S+'))), 6) FROM benchmark) AS avg_query_length, (SELECT count(DISTINCT x) FROM (SELECT unnest(w) AS x FROM t)) AS vocabulary,
  (SELECT count(*) FROM r) AS n_qrels, (SELECT count(DISTINCT doc_id) FROM r WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS missing_docs,
  (SELECT count(DISTINCT qid) FROM r WHERE qid NOT IN (SELECT item_id FROM benchmark)) AS missing_queries""",
    "docstore_upsert": "WITH n AS (SELECT doc_id + 500 AS doc_id, text || '!' AS text FROM documents) SELECT doc_id, md5(text) AS text_md5 FROM n UNION ALL SELECT doc_id, md5(text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n)",
    "docstore_stats": "SELECT count(*) AS n_docs, round(avg(length(coalesce(text, ''))), 6) AS mean_chars, sum(length(coalesce(text, '')))::BIGINT AS total_chars FROM documents",
    "binary_corpus_stats": "SELECT count(*) AS total_docs, sum(strlen(coalesce(text, '')))::BIGINT AS total_bytes, round(avg(strlen(coalesce(text, ''))), 6) AS avg_doc_length, max(strlen(coalesce(text, '')))::BIGINT AS max_doc_length FROM documents",
    "get_documents": "SELECT l.doc_id AS pos, l.doc_id * 2 AS doc_id, text FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id * 2",
    "contains_doc": "SELECT l.doc_id * 2 AS doc_id, d.doc_id IS NOT NULL AS present FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id * 2",
    "doc_batch": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100 OFFSET 95",
}
