"""Queries over documents and benchmark: text, index, scoring, contexts, readers, ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contexts as C
from ..operators import docstore as D
from ..operators import index as I
from ..operators import metrics as M
from ..operators import scoring as S
from ..operators import segments as G
from ..runtime import materialise, spread, table

WORDS = r"'[\p{L}\p{N}_]+'"
#: Fixed value: ASCII punctuation as an SQL string.
PUNCT_SQL = "'" + T.PUNCTUATION.replace("'", "''") + "'"


def docs(spark, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def queries(spark, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def qrels(spark, d: str) -> DataFrame:
    """A document that holds a benchmark passage is relevant to it."""
    held = C.passages_held(docs(spark, d), queries(spark, d))
    return held.select("qid", "doc_id", F.lit(1).alias("rel"))


QRELS_SQL = "SELECT item_id AS qid, doc_id, 1 AS rel FROM benchmark b JOIN documents d ON contains(d.text, b.text)"

BASE = rf"""
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), {WORDS})) AS term FROM benchmark) GROUP BY ALL),
dt AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {WORDS}) AS toks FROM documents),
dl AS (SELECT doc_id, len(toks) AS dl FROM dt),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM dt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""


def _scored(weight: str, k: int, name: str = "run") -> str:
    return f"""{BASE},
s_{name} AS (
  SELECT qid, p.doc_id, round(sum(qtf * {weight}), 6) AS score
  FROM qt JOIN p USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = p.doc_id, st GROUP BY ALL
),
{name} AS (
  SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s_{name} WHERE score > 0) WHERE rank <= {k}
)"""


def _bm25_weight(k1: str = "1.2::DOUBLE", b: str = "0.75::DOUBLE") -> str:
    return f"ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))"


RUN = _scored(_bm25_weight(), 10)


def bm25_run(spark, d: str, k: int = 10) -> DataFrame:
    return S.bm25(docs(spark, d), queries(spark, d), k)


def bm25_topk(spark, d: str) -> DataFrame:
    return bm25_run(spark, d)


def _with_contexts(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """(contexts, gathered by query); the run is short: ten rows a query."""
    ctx = materialise(C.contexts(bm25_run(spark, d), docs(spark, d)), "contexts")
    return ctx, C.gathered(queries(spark, d), C.dedupe_by_prefix(ctx))


def tokenize(spark, d):
    t = docs(spark, d).withColumn("t", T.tokens(F.col("text")))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def ws_tokens(spark, d):
    t = docs(spark, d).withColumn("t", T.ws_tokens(F.col("text")))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", T.normalised(F.col("text")).alias("normalized"))


def sentences(spark, d):
    s = docs(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return s.filter("sentence <> ''").select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


def question_type(spark, d):
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", T.question_type(F.col("text")).alias("question_type"))


def query_text(spark, d):
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", T.first_text(F.col("text"), F.col("role"), F.col("conv_id")).alias("query_text"))


def postings(spark, d):
    return G.kept(docs(spark, d)).postings.select("doc_id", "term", "tf")


def term_stats(spark, d):
    i = G.kept(docs(spark, d))
    t = i.terms.join(F.broadcast(i.stats))
    return t.select("term", "df", F.round(I.idf_bm25(F.col("n"), F.col("df")), 6).alias("idf_bm25"), F.round(I.idf_tfidf(F.col("n"), F.col("df")), 6).alias("idf_tfidf"))


def index_stats(spark, d):
    i = G.kept(docs(spark, d))
    n = i.terms.agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("df").alias("n_postings"))
    s = i.stats.join(F.broadcast(n))
    return s.select(F.col("n").alias("n_docs"), F.round("avgdl", 6).alias("avgdl"), "vocabulary", "n_postings", F.round(F.try_divide("n_postings", F.col("n") * F.col("vocabulary")), 9).alias("density"))


def vocabulary(spark, d):
    return I.vocabulary(docs(spark, d))


def query_terms_in_vocab(spark, d):
    return S.known_terms(docs(spark, d), queries(spark, d))


def tfidf_topk(spark, d):
    return S.tfidf(docs(spark, d), queries(spark, d))


def bm25_k1000_b0(spark, d):
    return S.bm25(docs(spark, d), queries(spark, d), k1=1000.0, b=0.0)


def bm25_okapi(spark, d):
    return S.bm25_okapi(docs(spark, d), queries(spark, d))


def bm25_term_weight(spark, d):
    return S.term_weights(docs(spark, d))


def empty_queries(spark, d):
    q = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.reverse("text").alias("text"))
    return S.empty_queries(docs(spark, d), q)


def first_k_reciprocal(spark, d):
    return D.first_k_reciprocal(docs(spark, d), 10)


def contexts(spark, d):
    return C.contexts(bm25_run(spark, d), docs(spark, d))


def dedupe_contexts(spark, d):
    return C.dedupe_by_prefix(contexts(spark, d)).select("qid", "doc_id", "rank")


def dedupe_fingerprint(spark, d):
    own = C.dedupe_by_fingerprint(contexts(spark, d))
    return own.select("qid", "doc_id", "rank", C.fingerprint(F.col("context")).alias("fingerprint"))


def hydrate(spark, d):
    return C.hydrate(bm25_run(spark, d), docs(spark, d))


def extractive_answer(spark, d):
    return C.extractive(_with_contexts(spark, d)[1])


def extractive_weighted(spark, d):
    ctx, _ = _with_contexts(spark, d)
    return C.extractive_weighted(C.gathered(queries(spark, d), ctx))


def generative_answer(spark, d):
    return C.generative(_with_contexts(spark, d)[1])


def generative_smart(spark, d):
    ctx, _ = _with_contexts(spark, d)
    return C.generative_smart(C.gathered(queries(spark, d), C.dedupe_by_fingerprint(ctx)))


def rag_predictions(spark, d):
    """The whole path: index, score, contexts, answer; one row a query."""
    run = materialise(bm25_run(spark, d), "run")
    ctx = materialise(C.contexts(run, docs(spark, d)), "contexts")
    answers = C.extractive(C.gathered(queries(spark, d), C.dedupe_by_prefix(ctx)))
    hits = run.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("doc_ids"), F.max("score").alias("best_score"))
    d = queries(spark, d).select("qid", F.col("text").alias("query")).join(answers, "qid").join(hits, "qid", "left")
    return d.select("qid", "query", "answer", "doc_ids", "best_score")


def ir_metrics(spark, d):
    run, rel = materialise(bm25_run(spark, d, 100), "run"), materialise(qrels(spark, d), "qrels")
    out = None
    for k in (10, 100):
        m = M.ranking_metrics(run, rel, k)
        m = m.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("ndcg", "ap", "recall", "precision")]).select(F.lit(k).cast("long").alias("k"), "*")
        out = m if out is None else out.unionByName(m)
    return out.withColumnRenamed("ap", "map")


def _categories(spark, d):
    return M.error_categories(queries(spark, d), bm25_run(spark, d), qrels(spark, d))


def error_categories(spark, d):
    return M.category_counts(materialise(_categories(spark, d), "categories"))


def error_samples(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("category").orderBy("qid")
    c = _categories(spark, d).withColumn("place", F.row_number().over(w)).filter("place <= 5")
    return c.select("category", "qid", F.col("place").cast("long").alias("place"))


def retrieval_pr(spark, d):
    return M.retrieval_means(_categories(spark, d))


def missing_refs(spark, d):
    rel = table(spark, d, "labels").select((F.col("doc_id") * 3).alias("doc_id"), (F.col("doc_id") % 97).alias("qid"))
    return D.missing_refs(docs(spark, d), queries(spark, d), rel)


def faithfulness(spark, d):
    ctx, own = _with_contexts(spark, d)
    a = C.extractive(own).join(own.select("qid", "contexts"), "qid")
    score, n = M.faithfulness(F.col("answer"), F.col("contexts"))
    return a.select("qid", score.alias("faithfulness"), n.alias("supporting"))


def _toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {WORDS})"


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CTX = f"""{RUN},
ctx AS (SELECT qid, d.doc_id, rank, substr(text, 1, {C.FOR_READER}) AS context, substr(text, 1, {C.STORED}) AS stored FROM run JOIN documents d USING (doc_id) WHERE length(text) > 0),
dd AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, substr(context, 1, 200) ORDER BY rank) AS i FROM ctx
                 WHERE rank <= {C.FOR_ANSWER} AND length({_STRIP.format('context')}) >= 20) WHERE i = 1
),
fp AS (SELECT *, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(context), '\\S+')[1:20])), ' ') AS fingerprint FROM ctx WHERE rank <= {C.FOR_FINGERPRINT}),
df4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, fingerprint ORDER BY rank) AS i FROM fp) WHERE i = 1)""".replace("\\\\S", "\\S")


def _best_sql(source: str, longest: int, score: str, rounded: bool = False) -> str:
    return f"""
se AS (
  SELECT qid, rank, pos, sentence FROM (
    SELECT qid, rank, unnest(range(1, len(ss) + 1)) AS pos, {_STRIP.format('unnest(ss)')} AS sentence
    FROM (SELECT qid, rank, string_split_regex(context, '[.!?]+') AS ss FROM {source})
  ) WHERE length(sentence) BETWEEN 10 AND {2 * longest}
),
sc AS (
  SELECT se.*, {score} AS sscore, len(q.qtoks) AS nq FROM se JOIN (SELECT item_id AS qid, list_distinct({_toks('text')}) AS qtoks FROM benchmark) q USING (qid)
),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sscore DESC, rank, pos) AS i FROM sc WHERE sscore > 0) WHERE i = 1)"""


_EXTRACT = f"""{_CTX},
{_best_sql('dd', 500, f"len(list_intersect(q.qtoks, {_toks('sentence')}))")},
fc AS (SELECT qid, arg_min(context, rank) AS first FROM dd GROUP BY qid),
ans AS (
  SELECT b.item_id AS qid, CASE WHEN fc.first IS NULL THEN '{C.NO_CONTEXT.replace("'", "''")}'
    WHEN sentence IS NULL THEN substr(fc.first, 1, 500) || '...'
    WHEN length(sentence) > 500 THEN substr(sentence, 1, 500) || '...' ELSE sentence END AS answer
  FROM benchmark b LEFT JOIN fc ON fc.qid = b.item_id LEFT JOIN best ON best.qid = b.item_id
)"""


def _any(*words: str) -> str:
    return "(" + " OR ".join(f"contains(lower(b.text), '{w}')" for w in words) + ")"


_NONE = C.NO_CONTEXT.replace("'", "''")
_CAT = f"""{RUN}, rel AS ({QRELS_SQL}), got AS (SELECT qid, doc_id FROM run),
cat AS (
  SELECT item_id AS qid, g.n_gold, r.n_got, x.n_both,
         CASE WHEN g.n_gold IS NULL THEN 'no_gold_standard' WHEN r.n_got IS NULL THEN 'no_retrieval' WHEN x.n_both IS NULL THEN 'retriever_miss' ELSE 'reader_issue' END AS category
  FROM benchmark b LEFT JOIN (SELECT qid, count(*) AS n_gold FROM rel GROUP BY qid) g ON g.qid = b.item_id
  LEFT JOIN (SELECT qid, count(*) AS n_got FROM got GROUP BY qid) r ON r.qid = b.item_id
  LEFT JOIN (SELECT qid, count(*) AS n_both FROM got JOIN rel USING (qid, doc_id) GROUP BY qid) x ON x.qid = b.item_id
)"""


def _metrics_sql(k: int) -> str:
    return f"""
SELECT {k}::BIGINT AS k, round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg, round(avg(coalesce(ap, 0) / n_rel), 6) AS map,
       round(avg(coalesce(n_hit, 0) / n_rel), 6) AS recall, round(avg(coalesce(n_hit, 0) / {k}), 6) AS precision
FROM (SELECT qid, count(*) AS n_rel, sum(CASE WHEN i <= {k} THEN 1 / log2(i + 1) ELSE 0 END) AS ideal
      FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS i FROM rel) GROUP BY qid)
LEFT JOIN (SELECT qid, sum(1 / log2(rank + 1)) AS dcg, sum(found / rank) AS ap, count(*) AS n_hit
           FROM (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS found FROM run100 JOIN rel USING (qid, doc_id) WHERE rank <= {k}) GROUP BY qid) USING (qid)"""


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, rag_predictions, tokenize, ws_tokens, normalize_text, sentences, question_type, query_text, postings, term_stats, index_stats, vocabulary,
        query_terms_in_vocab, tfidf_topk, bm25_k1000_b0, bm25_okapi, bm25_term_weight, empty_queries, first_k_reciprocal, contexts, dedupe_contexts,
        dedupe_fingerprint, hydrate, extractive_answer, extractive_weighted, generative_answer, generative_smart, ir_metrics, error_categories, error_samples,
        retrieval_pr, missing_refs, faithfulness,
    )
}

ORACLE_SQL = {
    "bm25_topk": f"WITH {RUN} SELECT qid, doc_id, score, rank FROM run",
    "tfidf_topk": f"WITH {_scored('tf * ln(n / (df + 1))', 10)} SELECT qid, doc_id, score, rank FROM run",
    "bm25_k1000_b0": f"WITH {_scored(_bm25_weight('1000.0::DOUBLE', '0.0::DOUBLE'), 10)} SELECT qid, doc_id, score, rank FROM run",
    "tokenize": f"WITH {BASE} SELECT doc_id, len(toks)::BIGINT AS n_tokens, array_to_string(toks, ' ') AS tokens FROM dt",
    "ws_tokens": r"SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\S+') AS t FROM documents)",
    "normalize_text": rf"SELECT doc_id, trim(regexp_replace(translate(lower(coalesce(text, '')), {PUNCT_SQL}, ''), '\s+', ' ', 'g')) AS normalized FROM documents",
    "sentences": f"SELECT doc_id, pos::BIGINT AS pos, sentence FROM (SELECT doc_id, unnest(range(0, len(s))) AS pos, {_STRIP.format('unnest(s)')} AS sentence FROM (SELECT doc_id, string_split_regex(text, '[.!?]+') AS s FROM documents)) WHERE sentence <> ''",
    "question_type": "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'what') OR contains(lower(text), 'who') THEN 'information' WHEN contains(lower(text), 'how') OR contains(lower(text), 'why') THEN 'explanation' ELSE 'general' END AS question_type FROM conversations",
    "query_text": f"SELECT conv_id, turn, coalesce(nullif({_STRIP.format('text')}, ''), nullif({_STRIP.format('role')}, ''), conv_id::VARCHAR) AS query_text FROM conversations",
    "postings": f"WITH {BASE} SELECT doc_id, term, tf FROM p",
    "term_stats": f"WITH {BASE} SELECT term, df, round(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf_bm25, round(ln(n / (df + 1)), 6) AS idf_tfidf FROM df, st",
    "index_stats": f"WITH {BASE} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, v AS vocabulary, np AS n_postings, round(np / (n * v), 9) AS density FROM st, (SELECT count(*) AS v, sum(df)::BIGINT AS np FROM df)",
    "vocabulary": f"WITH {BASE} SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM df",
    "query_terms_in_vocab": f"WITH {BASE} SELECT qid, term, qtf FROM qt WHERE term IN (SELECT term FROM df)",
    "bm25_okapi": r"""WITH qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '\S+')) AS term FROM benchmark) GROUP BY ALL),
dt AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\S+') AS toks FROM documents), dl AS (SELECT doc_id, len(toks) AS dl FROM dt), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM dt) GROUP BY ALL),
i AS (SELECT term, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS raw FROM p, st GROUP BY term, n),
f AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM i) ELSE raw END AS idf FROM i),
s AS (SELECT qid, p.doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM qt JOIN p USING (term) JOIN f USING (term) JOIN dl ON dl.doc_id = p.doc_id, st GROUP BY ALL)
SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
    "bm25_term_weight": f"WITH {BASE} SELECT p.doc_id, term, round({_bm25_weight()}, 6) AS weight FROM p JOIN df USING (term) JOIN dl ON dl.doc_id = p.doc_id, st",
    "empty_queries": f"""WITH {BASE}, cq AS (SELECT conv_id * 1000 + turn AS qid, reverse(text) AS text FROM conversations),
k AS (SELECT qid, count(*) AS n FROM (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(text), {WORDS})) AS term FROM cq) WHERE term IN (SELECT term FROM df) GROUP BY qid)
SELECT cq.qid, coalesce(n, 0) AS n_known_terms, n IS NULL AS is_empty FROM cq LEFT JOIN k USING (qid)""",
    "first_k_reciprocal": "SELECT doc_id, round(1 / row_number() OVER (ORDER BY doc_id), 6) AS score FROM documents ORDER BY doc_id LIMIT 10",
    "contexts": f"WITH {_CTX} SELECT qid, doc_id, rank, context, stored FROM ctx",
    "dedupe_contexts": f"WITH {_CTX} SELECT qid, doc_id, rank FROM dd",
    "dedupe_fingerprint": f"WITH {_CTX} SELECT qid, doc_id, rank, fingerprint FROM df4",
    "hydrate": f"WITH {RUN} SELECT qid, doc_id, score, text FROM run JOIN documents USING (doc_id)",
    "extractive_answer": f"WITH {_EXTRACT} SELECT qid, answer FROM ans",
    "rag_predictions": f"WITH {_EXTRACT} SELECT b.item_id AS qid, b.text AS query, answer, doc_ids, best_score FROM benchmark b JOIN ans ON ans.qid = b.item_id LEFT JOIN (SELECT qid, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS doc_ids, max(score) AS best_score FROM run GROUP BY qid) h ON h.qid = b.item_id",
    "extractive_weighted": f"""WITH {_CTX}, c5 AS (SELECT * FROM ctx WHERE rank <= 5),
{_best_sql('(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS j FROM ctx) WHERE j <= 5)', 200, f"round(CASE WHEN len(q.qtoks) > 0 THEN len(list_intersect(q.qtoks, {_toks('sentence')})) / len(q.qtoks)::DOUBLE ELSE 0 END * 0.7::DOUBLE + least(1.0::DOUBLE, 50 / len(regexp_extract_all(sentence, '[^[:space:]]+'))::DOUBLE) * 0.2::DOUBLE + 0.1::DOUBLE, 9)")},
fc AS (SELECT qid, arg_min(context, rank) AS first FROM ctx GROUP BY qid)
SELECT b.item_id AS qid, CASE WHEN fc.first IS NULL THEN '{_NONE}'
  WHEN sentence IS NULL AND length(fc.first) > 200 THEN substr(fc.first, 1, 200) || '...' WHEN sentence IS NULL THEN fc.first
  WHEN length(sentence) > 200 THEN array_to_string(regexp_extract_all(sentence, '[^[:space:]]+')[1:25], ' ') || '...' ELSE sentence END AS answer
FROM benchmark b LEFT JOIN fc ON fc.qid = b.item_id LEFT JOIN best ON best.qid = b.item_id""",
    "generative_answer": f"""WITH {_CTX}, j AS (SELECT qid, substr(string_agg(context, ' | ' ORDER BY rank), 1, 500) AS c FROM dd GROUP BY qid)
SELECT b.item_id AS qid, CASE WHEN c IS NULL THEN '{_NONE}' WHEN {_any('what', 'who')} THEN 'According to the information: ' || c
  WHEN {_any('how', 'why')} THEN 'The explanation is: ' || c ELSE 'Based on the context: ' || c END AS answer FROM benchmark b LEFT JOIN j ON j.qid = b.item_id""",
    "generative_smart": f"""WITH {_CTX}, j0 AS (SELECT qid, string_agg(context, ' | ' ORDER BY rank) AS c FROM df4 GROUP BY qid),
j1 AS (SELECT qid, c, substr(c, 1, 800) AS h, instr(reverse(substr(c, 1, 800)), '.') AS r FROM j0),
j AS (SELECT qid, CASE WHEN length(c) <= 800 THEN c WHEN r > 0 AND 800 - r > 640 THEN substr(h, 1, 801 - r) ELSE h END AS c FROM j1)
SELECT b.item_id AS qid, CASE WHEN c IS NULL THEN '{_NONE}'
  WHEN {_STRIP.format('c')} = '' THEN 'The available information doesn''t contain relevant details to answer this question.'
  WHEN {_any('what', 'which', 'who')} AND {_any('definition', 'meaning')} THEN 'Based on the information provided: ' || c
  WHEN {_any('what', 'which', 'who')} THEN 'According to the sources, ' || c WHEN {_any('how', 'why')} THEN 'The explanation is: ' || c
  WHEN {_any('when', 'where')} THEN 'The information indicates: ' || c WHEN {_any('is', 'are', 'does', 'do', 'can', 'will')} THEN 'Based on the available  ' || c
  ELSE 'Regarding your question: ' || c END AS answer FROM benchmark b LEFT JOIN j ON j.qid = b.item_id""",
    "ir_metrics": f"WITH {_scored(_bm25_weight(), 100, 'run100')}, rel AS ({QRELS_SQL}) {_metrics_sql(10)} UNION ALL {_metrics_sql(100)}",
    "error_categories": f"WITH {_CAT} SELECT category, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM cat), 6) AS percent FROM cat GROUP BY category",
    "error_samples": f"WITH {_CAT} SELECT * FROM (SELECT category, qid, row_number() OVER (PARTITION BY category ORDER BY qid) AS place FROM cat) WHERE place <= 5",
    "retrieval_pr": f"WITH {_CAT} SELECT round(avg(coalesce(n_both, 0) / n_gold), 6) AS avg_recall, round(avg(coalesce(n_both, 0) / n_got), 6) AS avg_precision, count(*) AS n_queries FROM cat WHERE n_gold > 0 AND n_got > 0",
    "missing_refs": """WITH r AS (SELECT doc_id * 3 AS doc_id, doc_id % 97 AS qid FROM labels)
SELECT DISTINCT 'document' AS kind, doc_id AS id FROM r WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT DISTINCT 'query', qid FROM r WHERE qid NOT IN (SELECT item_id FROM benchmark)""",
    "faithfulness": rf"""WITH {_EXTRACT}, n AS (SELECT qid, list_distinct(list_filter(string_split(trim(regexp_replace(translate(lower(answer), {PUNCT_SQL}, ''), '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS a FROM ans),
o AS (SELECT dd.qid, len(list_intersect(n.a, string_split(trim(regexp_replace(translate(lower(context), {PUNCT_SQL}, ''), '\s+', ' ', 'g')), ' '))) AS c FROM dd JOIN n USING (qid))
SELECT n.qid, round(CASE WHEN len(a) > 0 THEN least(1.0::DOUBLE, coalesce(sum(c), 0) / len(a)::DOUBLE) ELSE 0 END, 6) AS faithfulness, count(*) FILTER (WHERE c > 0) AS supporting FROM n LEFT JOIN o USING (qid) GROUP BY n.qid, a""",
}
