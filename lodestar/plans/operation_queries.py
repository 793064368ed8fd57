"""Queries over files that are written and read again, registries, suites, grades and estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contexts as C
from ..operators import docstore as D
from ..operators import index as I
from ..operators import monitoring as N
from ..operators import scoring as S
from ..operators import segments as G
from ..runtime import scratch_path, table
from ..sources import sinks
from ..sources import text_files as L
from . import experiment as E
from . import report, suite
from .analytics_queries import _INT8, _LOG, _QL, _SYM, log, qrels_lines
from .registry import readers, retrievers
from .retrieval_queries import _CTX, _EXTRACT, _NONE, _STRIP, BASE, WORDS, _any, _bm25_weight, _scored, bm25_run, docs, queries, rag_predictions
from .retrieval_queries import ORACLE_SQL as _RETRIEVAL


def _titled(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.titled(F.col("source"), F.col("text")).alias("text"))


def title_text(spark, d):
    return _titled(spark, d)


def bm25_okapi_titled(spark, d):
    return S.bm25_okapi(_titled(spark, d), queries(spark, d))


def load_qrels_strict(spark, d):
    return L.load_qrels(qrels_lines(spark, d), strict=True)


def jsonl_round_trip(spark, d):
    """Documents written as JSON lines and read as a corpus."""
    at = scratch_path(spark, "corpus-jsonl")
    t = table(spark, d, "documents")
    sinks.json_lines(t.select(F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("title"), "text"), at)
    return L.load_corpus(L.lines(spark, at))


def load_predictions(spark, d):
    """Files that are JSON arrays, a line an element."""
    at = scratch_path(spark, "predictions")
    one = F.struct(F.col("item_id").cast("string").alias("docid"), F.substring("text", 1, 20).alias("text"))
    scores = F.create_map(F.col("item_id").cast("string"), (F.col("item_id") / 4).cast("double"))
    q = table(spark, d, "benchmark").filter("item_id IS NOT NULL").repartition(8)
    sinks.json_arrays(q.select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"), F.reverse("text").alias("answer"), F.array(one).alias("contexts"), scores.alias("retriever_scores")), at)
    p = L.load_predictions(spark, at)
    return p.select("qid", "query", "answer", F.col("contexts")[0]["docid"].alias("docid"), F.col("contexts")[0]["text"].alias("context"), F.element_at("retriever_scores", F.col("qid")).alias("score"))


def validate_dataset(spark, d):
    """file, error, n of a data set's folder whose judgements have errors."""
    at = scratch_path(spark, "dataset")
    t, q = docs(spark, d), queries(spark, d)
    sinks.json_lines(t.filter("text <> ''").select(F.col("doc_id").cast("string").alias("_id"), "text"), f"{at}/corpus.jsonl")
    sinks.json_lines(q.select(F.col("qid").cast("string").alias("_id"), "text"), f"{at}/queries.jsonl")
    qrels_lines(spark, d).orderBy("ord").select("line").write.text(f"{at}/qrels/test.tsv")
    _, found, _ = report.validate(spark, at)
    return found.groupBy("file", "error").agg(F.count(F.lit(1)).alias("n"))


def file_checksum(spark, d):
    """part, SHA-256 of files with every sixteenth passage, in order."""
    at = scratch_path(spark, "checksum")
    own = queries(spark, d).withColumn("part", F.pmod("qid", F.lit(16))).repartition("part").sortWithinPartitions("part", "qid")
    own.select("part", "text").write.partitionBy("part").text(at)
    return L.checksum(spark, at).select(F.regexp_extract("path", r"part=(\d+)/", 1).cast("long").alias("part"), "sha256")


def vector_records(spark, d):
    """Embeddings as packed little-endian records, and back."""
    v = table(spark, d, "embeddings")
    dim = v.select(F.size("embedding")).first()[0]
    back = L.unpacked(L.packed(v.select("vec_id", "embedding")), dim).select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return back.select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))


def index_reload(spark, d):
    """An index written under its content's key and loaded again: term, documents, occurrences."""
    at, t = scratch_path(spark, "index"), docs(spark, d)
    key = I.content_key(t)
    G.save(t, at, key)
    again = G.load(spark, at, key)
    cf = again.postings.groupBy("term").agg(F.sum("tf").alias("cf"))
    return again.terms.join(cf, "term").select("term", "df", "cf")


def predictions_sink(spark, d):
    at = scratch_path(spark, "predictions")
    rag_predictions(spark, d).write.json(at)
    return spark.read.schema("qid long, answer string, doc_ids string, best_score double").json(at)


def _by_type(spark, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def report_markdown(spark, d):
    return sinks.markdown_lines(_by_type(spark, d))


def report_csv(spark, d):
    at = scratch_path(spark, "csv")
    sinks.csv(_by_type(spark, d), at)
    return spark.read.schema("event_type string, n long").option("header", True).csv(at)


def query_log_sink(spark, d):
    """A log appended twice, by day."""
    at = scratch_path(spark, "query-log")
    for _ in range(2):
        sinks.query_log(log(spark, d), at)
    return spark.read.json(at).groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count(F.lit(1)).alias("n"))


def experiment_counts(spark, d):
    """Each user's events stand for an experiment."""
    r = log(spark, d).groupBy("user_id").agg(
        F.max(F.when(F.col("failed") & (F.col("query_id") % 7 == 0), "failed")).alias("error"), F.count(F.lit(1)).alias("processed"),
        F.sum("latency_ms").alias("seconds"), F.min("latency_ms").alias("build_seconds"),
    )
    return N.experiment_counts(r)


def overall_grades(spark, d):
    return N.overall_grades(log(spark, d).select("user_id", (F.col("latency_ms") >= 30).alias("passed")), "user_id")


def recommendations(spark, d):
    """Suites and their checks; a method's mean latency decides."""
    m = log(spark, d).groupBy("method").agg(F.avg("latency_ms").alias("m"), F.avg(F.length("method")).alias("l"))
    c = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.lit(k).alias("check")) for c, k in suite.ADVICE])).alias("x"), "m", "l")
    c = c.select("x.*", (F.length(F.concat("x.component", "x.check")) < F.col("l") + F.col("m") % 10).alias("passed"))
    return N.recommendations(c, suite.ADVICE)


def index_scaling(spark, d):
    """n, vocabulary, postings of the index of the first n documents by id."""
    return E.index_sizes(docs(spark, d), (100, 500, 1000))


def size_estimate(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", T.size_estimate(F.col("doc_id"), F.col("text"), F.col("source"), F.col("lang")).cast("long").alias("bytes"))


def build_time_estimate(spark, d):
    e = table(spark, d, "events").filter("value IS NOT NULL")
    return e.select("event_id", T.build_time_estimate(F.col("value") * F.col("event_id"), 10.0).alias("estimate"))


def _read(spark, d: str) -> DataFrame:
    return C.gathered(queries(spark, d), C.contexts(bm25_run(spark, d), docs(spark, d)))


def first_context(spark, d):
    return C.first_context(_read(spark, d))


def generative_simple(spark, d):
    return C.generative_simple(_read(spark, d))


def llm_placeholder(spark, d):
    return C.placeholder(_read(spark, d), "model")


#: What the queries over the registries create.
_RETRIEVERS, _READERS = ("bm25", "BM25_custom", "tfidf"), ("extractive", "generative", "first_context")


def registry_runs(spark, d):
    t, q, out = docs(spark, d), queries(spark, d), None
    for name in _RETRIEVERS:
        run = retrievers.create(name)(t, q, 10).select(F.lit(name).alias("name"), "qid", "doc_id", "score", "rank")
        out = run if out is None else out.unionByName(run)
    return out


def registry_readers(spark, d):
    q = C.gathered(queries(spark, d), C.dedupe_by_prefix(C.contexts(bm25_run(spark, d), docs(spark, d))))
    out = None
    for name in _READERS:
        own = readers.create(name)(q).select(F.lit(name).alias("name"), "qid", "answer")
        out = own if out is None else out.unionByName(own)
    return out


def hybrid_topk(spark, d):
    """Documents and passages that have a vector of their id."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    t = docs(spark, d).join(v, "doc_id")
    q = queries(spark, d).join(v.withColumnRenamed("doc_id", "qid"), "qid")
    return retrievers.create("hybrid")(t, q, 10)


_GRID = {"retriever.type": ["bm25", "tfidf"], "retriever.params.top_k": [3, 10]}


def ablation_grid(spark, d):
    """The retrievers of a grid of configurations, each run: hits, queries with a hit and the sum of scores."""
    base = {"output_dir": "out", "experiments": [{"name": "base", "retriever": {"type": "okapi", "params": {"top_k": 1}}}]}
    out = None
    for name, config in E.ablations(base, _GRID):
        x = config["experiments"][0]["retriever"]
        run = retrievers.create(x["type"])(docs(spark, d), queries(spark, d), x["params"]["top_k"])
        own = run.agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("qid").alias("queries"), F.round(F.sum(F.col("score").cast("decimal(20,6)")), 3).cast("double").alias("total"))
        own = own.select(F.lit(name).alias("name"), "hits", "queries", "total")
        out = own if out is None else out.unionByName(own)
    return out


class _Counted(suite.Suite):
    """A suite over a table: its rows and words; it fails at a step, with what it has read."""

    category = "tables"

    def __init__(self, name: str, data: DataFrame, fails: str = ""):
        self.name, self.data, self.fails, self.steps = name, data, fails, []

    def _step(self, step: str) -> None:
        self.steps.append(step)
        if self.fails == step:
            raise ValueError(f"{step}: {self.data.agg(F.max('doc_id')).first()[0]}")

    def setup(self, spark):
        self._step("setup")

    def run(self, spark):
        self._step("run")
        n, words = self.data.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(T.tokens(F.col("text")))), F.lit(0))).first()
        return {"rows": n, "words": words}

    def cleanup(self, spark):
        self._step("cleanup")


def suite_runs(spark, d):
    """Suites over the documents of each language that go through, and that fail at each step."""
    t = table(spark, d, "documents").filter("lang IS NOT NULL")
    own = [_Counted(r.lang, t.filter(F.col("lang") == r.lang)) for r in t.select("lang").distinct().orderBy("lang").collect()]  # a few languages
    own += [_Counted(f"fails at {s}", t, s) for s in ("setup", "run", "cleanup")]
    done = suite.run_suites(spark, own)
    rows = [(r["suite"], ",".join(s.steps), r["figures"].get("rows"), r["figures"].get("words"), r["error"]) for r, s in zip(done, own, strict=True)]
    return spark.createDataFrame(rows, "suite string, steps string, n long, n_words long, error string")


def measured_calls(spark, d):
    """Searches of each eighth of the queries, as a harness measures them: hits and failures; of these calls some fail."""
    index, asked, hits, out = G.kept(docs(spark, d)), queries(spark, d), {}, []

    def call(part):
        hits[part] = S.bm25(index, asked.filter(F.pmod("qid", F.lit(8)) == part), 5).count()
        if part % 3 == 0:
            raise LookupError(f"part {part} has {hits[part]} hits")

    for part in range(8):
        m = E.measured(call, part)
        out.append((part, hits.get(part), m["error"], m["seconds"] > 0))
    return spark.createDataFrame(out, "part long, hits long, error string, timed boolean")


def docstore_lookup(spark, d):
    """Documents of a saved store by id: buckets of other ids are not read."""
    at = scratch_path(spark, "store")
    D.save(docs(spark, d), at)
    wanted = table(spark, d, "labels").select((F.col("doc_id") * 2).alias("doc_id"))
    return D.find(spark, at, wanted).select("doc_id", F.md5("text").alias("text_md5"))


def docstore_reopened(spark, d):
    """A store that is saved, opened, added to and rewritten keeps its old documents."""
    at, to, t = scratch_path(spark, "store"), scratch_path(spark, "store"), docs(spark, d)
    D.save(t, at)
    new = t.filter("doc_id % 3 = 0").select((F.col("doc_id") + 100).alias("doc_id"), F.reverse("text").alias("text"))
    D.save(D.upsert(D.load(spark, at), new), to, files=2)
    return D.load(spark, to).select("doc_id", F.md5("text").alias("text_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        title_text, bm25_okapi_titled, load_qrels_strict, jsonl_round_trip, load_predictions, validate_dataset, file_checksum, vector_records, index_reload,
        predictions_sink, report_markdown, report_csv, query_log_sink, experiment_counts, overall_grades, recommendations, index_scaling, size_estimate,
        build_time_estimate, first_context, generative_simple, llm_placeholder, registry_runs, registry_readers, hybrid_topk, ablation_grid, suite_runs,
        measured_calls, docstore_reopened, docstore_lookup,
    )
}

_TITLED = f"(SELECT doc_id, {_STRIP.format('''source || ' ' || coalesce(text, '')''')} AS text FROM documents)"
_FIRST = "fx AS (SELECT qid, string_agg(context, ' | ' ORDER BY rank) AS joined, arg_min(context, rank) AS first, count(*) AS n FROM ctx GROUP BY qid)"
_ALL = "fx0 AS (SELECT qid, arg_min(context, rank) AS first FROM dd GROUP BY qid)"
_CUT = "CASE WHEN {0} IS NULL THEN '" + C.NO_ANSWER + "' WHEN length({0}) > 200 THEN substr({0}, 1, 200) || '...' ELSE {0} END"
_BY_TYPE = "(SELECT event_type, count(*) AS n FROM events GROUP BY event_type)"


def _advice() -> str:
    return ", ".join(f"('{c}', '{k}', '{t}')" for (c, k), t in suite.ADVICE.items())


def _grid() -> str:
    weights, parts = {"bm25": _bm25_weight(), "tfidf": "tf * ln(n / (df + 1))"}, []
    for r in _GRID["retriever.type"]:
        for k in _GRID["retriever.params.top_k"]:
            parts.append(f"SELECT 'retriever.type={r},retriever.params.top_k={k}' AS name, count(*) AS hits, count(DISTINCT qid) AS queries, round(sum(score::DECIMAL(20, 6)), 3)::DOUBLE AS total FROM (WITH {_scored(weights[r], k)} SELECT * FROM run)")
    return " UNION ALL ".join(parts)


ORACLE_SQL = {
    "title_text": f"SELECT doc_id, text FROM {_TITLED}",
    "bm25_okapi_titled": _RETRIEVAL["bm25_okapi"].replace("FROM documents", f"FROM {_TITLED}"),
    "load_qrels_strict": f"""WITH {_QL}, f AS (SELECT ord, CASE WHEN contains(line, chr(9)) THEN string_split(line, chr(9)) ELSE string_split(line, ' ') END AS p FROM ql)
SELECT p[1] AS qid, p[2] AS doc_id, p[3]::INT AS rel FROM f WHERE len(p) >= 3 AND regexp_full_match(p[3], '[+-]?[0-9]+')""",
    "jsonl_round_trip": "SELECT doc_id::VARCHAR AS doc_id, nullif(source, '') AS title, nullif(text, '') AS text FROM documents",
    "load_predictions": "SELECT item_id::VARCHAR AS qid, text AS query, reverse(text) AS answer, item_id::VARCHAR AS docid, substr(text, 1, 20) AS context, item_id / 4::DOUBLE AS score FROM benchmark",
    "validate_dataset": f"""WITH {_QL}, f AS (SELECT string_split(line, chr(9)) AS p FROM ql), g AS (SELECT p[1] AS qid, p[2] AS doc_id, p[3] AS s FROM f WHERE len(p) = 3),
e AS (SELECT 'expected 3 fields' AS error FROM f WHERE len(p) <> 3
UNION ALL SELECT 'unknown query' FROM g WHERE qid NOT IN (SELECT item_id::VARCHAR FROM benchmark)
UNION ALL SELECT 'unknown document' FROM g WHERE doc_id NOT IN (SELECT doc_id::VARCHAR FROM documents WHERE text <> '')
UNION ALL SELECT CASE WHEN NOT regexp_full_match(s, '[+-]?[0-9]+') THEN 'score is no integer' ELSE 'score is not 0 or 1' END FROM g WHERE NOT regexp_full_match(s, '[+-]?[0-9]+') OR s NOT IN ('0', '1'))
SELECT 'qrels' AS file, error, count(*) AS n FROM e GROUP BY error""",
    "file_checksum": "SELECT item_id % 16 AS part, sha256(string_agg(text || chr(10), '' ORDER BY item_id)) AS sha256 FROM benchmark GROUP BY 1",
    "vector_records": "SELECT vec_id, unnest(range(0, len(embedding)))::BIGINT AS i, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings",
    "index_reload": f"WITH {BASE} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term",
    "predictions_sink": f"WITH {_EXTRACT} SELECT b.item_id AS qid, answer, doc_ids, best_score FROM benchmark b JOIN ans ON ans.qid = b.item_id LEFT JOIN (SELECT qid, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS doc_ids, max(score) AS best_score FROM run GROUP BY qid) h ON h.qid = b.item_id",
    "report_markdown": f"""WITH c AS (SELECT event_type AS e, n::VARCHAR AS n FROM {_BY_TYPE}), w AS (SELECT greatest(10, max(length(e)))::INT AS a, greatest(1, max(length(n)))::INT AS b FROM c),
l AS (SELECT '| ' || rpad(e, a, ' ') || ' | ' || rpad(n, b, ' ') || ' |' AS line FROM c, w)
SELECT 0::BIGINT AS ord, '| ' || rpad('event_type', a, ' ') || ' | ' || rpad('n', b, ' ') || ' |' AS line FROM w UNION ALL SELECT 1, '|' || repeat('-', a + 2) || '|' || repeat('-', b + 2) || '|' FROM w
UNION ALL SELECT row_number() OVER (ORDER BY line) + 1, line FROM l""",
    "report_csv": f"SELECT event_type, n FROM {_BY_TYPE}",
    "query_log_sink": "SELECT strftime(ts, '%Y-%m-%d') AS dt, 2 * count(*) AS n FROM events GROUP BY 1",
    "experiment_counts": f"""WITH {_LOG}, r AS (SELECT user_id, max(CASE WHEN failed AND query_id % 7 = 0 THEN 'failed' END) AS error, count(*) AS p, sum(latency_ms) AS s, min(latency_ms) AS b FROM lg GROUP BY user_id)
SELECT count(*) FILTER (WHERE error IS NULL) AS succeeded, count(*) FILTER (WHERE error IS NOT NULL) AS failed, round(sum(p) FILTER (WHERE error IS NULL) / sum(s - b) FILTER (WHERE error IS NULL), 6) AS queries_per_second FROM r""",
    "overall_grades": f"""WITH {_LOG}, s AS (SELECT user_id, avg(CASE WHEN latency_ms >= 30 THEN 1.0::DOUBLE ELSE 0 END) AS s FROM lg GROUP BY user_id)
SELECT user_id, round(s, 6) AS score, CASE WHEN s >= 0.9::DOUBLE THEN 'A+' WHEN s >= 0.8::DOUBLE THEN 'A' WHEN s >= 0.7::DOUBLE THEN 'B' WHEN s >= 0.6::DOUBLE THEN 'C' WHEN s >= 0.5::DOUBLE THEN 'D' ELSE 'F' END AS grade FROM s""",
    "recommendations": f"""WITH {_LOG}, m AS (SELECT method, avg(latency_ms) AS m, avg(length(method)) AS l FROM lg GROUP BY method), a(component, "check", text) AS (VALUES {_advice()}),
c AS (SELECT component, "check", text, coalesce(length(component || "check") < l + m % 10, false) AS passed FROM m, a)
SELECT DISTINCT component, text FROM c WHERE NOT passed
UNION ALL SELECT 'general', 'Begin with the components of the lowest scores.' FROM (SELECT avg(passed::INT) AS s FROM c) WHERE s < 0.8""",
    "index_scaling": f"""WITH {BASE}, o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
k AS (SELECT DISTINCT least(x, (SELECT count(*) FROM o)) AS n FROM (SELECT unnest([100, 500, 1000, (SELECT count(*) FROM o)]) AS x))
SELECT n, (SELECT count(DISTINCT term) FROM p JOIN o USING (doc_id) WHERE i <= n) AS vocabulary, (SELECT count(*) FROM p JOIN o USING (doc_id) WHERE i <= n) AS postings FROM k""",
    "size_estimate": "SELECT doc_id, 4 * (length(doc_id::VARCHAR) + length(coalesce(text, '')) + length(coalesce(source, '')) + length(coalesce(lang, '')))::BIGINT AS bytes FROM documents",
    "build_time_estimate": """WITH m AS (SELECT event_id, value * event_id / 10::DOUBLE / 60 AS m FROM events WHERE value IS NOT NULL)
SELECT event_id, CASE WHEN m < 1 THEN '~' || floor(m * 60)::BIGINT || 's' WHEN m < 60 THEN '~' || floor(m)::BIGINT || 'm' ELSE '~' || floor(m / 60)::BIGINT || 'h' || floor(m % 60)::BIGINT || 'm' END AS estimate FROM m""",
    "first_context": f"WITH {_CTX}, {_FIRST} SELECT b.item_id AS qid, {_CUT.format('first')} AS answer FROM benchmark b LEFT JOIN fx ON fx.qid = b.item_id",
    "generative_simple": f"""WITH {_CTX}, r2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS i FROM ctx), j AS (SELECT qid, substr(string_agg(context, ' ' ORDER BY rank), 1, 800) AS c FROM r2 WHERE i <= 2 GROUP BY qid)
""" + _RETRIEVAL["generative_smart"][_RETRIEVAL["generative_smart"].index("SELECT b.item_id"):],
    "llm_placeholder": f"WITH {_CTX}, {_FIRST} SELECT item_id AS qid, '[model] ' || text || ' (' || coalesce(n, 0) || ' contexts)' AS answer FROM benchmark LEFT JOIN fx ON fx.qid = item_id",
    "registry_runs": f"""WITH {_scored(_bm25_weight(), 10, 'rb')}, {_scored('tf * ln(n / (df + 1))', 10, 'rt')[len(BASE) + 1:]}
SELECT 'bm25' AS name, qid, doc_id, score, rank FROM rb UNION ALL SELECT 'BM25_custom', qid, doc_id, score, rank FROM rb UNION ALL SELECT 'tfidf', qid, doc_id, score, rank FROM rt""",
    "registry_readers": f"""WITH {_EXTRACT}, j AS (SELECT qid, substr(string_agg(context, ' | ' ORDER BY rank), 1, 500) AS c FROM dd GROUP BY qid), {_ALL}
SELECT 'extractive' AS name, qid, answer FROM ans
UNION ALL SELECT 'generative', b.item_id, CASE WHEN c IS NULL THEN '{_NONE}' WHEN {_any('what', 'who')} THEN '{C.INFORMATION}' || c WHEN {_any('how', 'why')} THEN '{C.EXPLANATION}' || c ELSE '{C.CONTEXT}' || c END FROM benchmark b LEFT JOIN j ON j.qid = b.item_id
UNION ALL SELECT 'first_context', b.item_id, {_CUT.format('first')} FROM benchmark b LEFT JOIN fx0 ON fx0.qid = b.item_id""",
    "hybrid_topk": f"""WITH {_scored(_bm25_weight(), 50, 'rs').replace('FROM documents)', 'FROM documents SEMI JOIN embeddings ON vec_id = doc_id)').replace('FROM benchmark)', 'FROM benchmark SEMI JOIN embeddings ON vec_id = item_id)')},
{_SYM}, rv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT a.doc_id AS qid, b.doc_id, round({_INT8}, 6) AS score FROM q a JOIN q b ON true WHERE a.doc_id IN (SELECT item_id FROM benchmark) AND b.doc_id IN (SELECT doc_id FROM documents))) WHERE rank <= 50),
h AS (SELECT qid, doc_id, round(sum(w), 6) AS score FROM (SELECT qid, doc_id, 0.3::DOUBLE / rank AS w FROM rs UNION ALL SELECT qid, doc_id, 0.7::DOUBLE / rank FROM rv) GROUP BY ALL)
SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM h) WHERE rank <= 10""",
    "ablation_grid": _grid(),
    "suite_runs": rf"""WITH w AS (SELECT lang, count(*) AS n, sum(len(regexp_extract_all(lower(coalesce(text, '')), {WORDS})))::BIGINT AS n_words FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT lang AS suite, 'setup,run,cleanup' AS steps, n, n_words, NULL::VARCHAR AS error FROM w
UNION ALL SELECT 'fails at setup', 'setup,cleanup', NULL, NULL, 'ValueError: setup: ' || (SELECT max(doc_id) FROM documents WHERE lang IS NOT NULL)
UNION ALL SELECT 'fails at run', 'setup,run,cleanup', NULL, NULL, 'ValueError: run: ' || (SELECT max(doc_id) FROM documents WHERE lang IS NOT NULL)
UNION ALL SELECT 'fails at cleanup', 'setup,run,cleanup', (SELECT sum(n)::BIGINT FROM w), (SELECT sum(n_words)::BIGINT FROM w), 'ValueError: cleanup: ' || (SELECT max(doc_id) FROM documents WHERE lang IS NOT NULL)""",
    "measured_calls": f"""WITH {_scored(_bm25_weight(), 5)}, h AS (SELECT part, count(run.doc_id) AS hits FROM (SELECT unnest(range(8)) AS part) LEFT JOIN run ON run.qid % 8 = part GROUP BY part)
SELECT part, hits, CASE WHEN part % 3 = 0 THEN 'LookupError: part ' || part || ' has ' || hits || ' hits' END AS error, true AS timed FROM h""",
    "docstore_lookup": "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id IN (SELECT doc_id * 2 FROM labels)",
    "docstore_reopened": "WITH n AS (SELECT doc_id + 100 AS doc_id, reverse(text) AS text FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, md5(text) AS text_md5 FROM n UNION ALL SELECT doc_id, md5(text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n)",
}
