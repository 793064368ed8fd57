"""Contexts of retrieved documents, and the answer readers over them.

Readers take one row per query: qid, query and contexts, the texts by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import clipped, cut_at_sentence, has_any, sentences, strip, tokens, ws_tokens
from ..runtime import in_blocks

RETRIEVED, FOR_READER, STORED = 10, 1000, 500
FOR_ANSWER, FOR_FINGERPRINT = 5, 4
#: Answers where there is nothing to answer from, and what leads an answer by kind of question.
NO_CONTEXT = "I don't have enough information to answer this question."
NO_ANSWER = "Unable to extract answer."
NOT_RELEVANT = "The available information doesn't contain relevant details to answer this question."
INFORMATION, EXPLANATION, CONTEXT = "According to the information: ", "The explanation is: ", "Based on the context: "
DEFINITION, SOURCES, INDICATION, AVAILABLE, GENERAL = (
    "Based on the information provided: ", "According to the sources, ", "The information indicates: ", "Based on the available  ", "Regarding your question: ",
)
#: Bytes of passages looked for in one pass over the documents.
_PASSAGES = 2 << 20


def contexts(run: DataFrame, docs: DataFrame, hits: int = RETRIEVED) -> DataFrame:
    """qid, doc_id, rank, text for the reader and text to be stored; empty texts fall out.

    The ranking is cut before the texts are joined.
    """
    top = run.filter(F.col("rank") <= hits).select("qid", "doc_id", "rank")
    t = docs.select("doc_id", "text").filter(F.length("text") > 0).join(top, "doc_id")
    return t.select("qid", "doc_id", "rank", F.substring("text", 1, FOR_READER).alias("context"), F.substring("text", 1, STORED).alias("stored"))


def hydrate(run: DataFrame, docs: DataFrame) -> DataFrame:
    """Run rows with the text; hits whose document is gone fall out."""
    return run.select("qid", "doc_id", "score").join(docs.select("doc_id", "text"), "doc_id").select("qid", "doc_id", "score", "text")


def passages_held(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """qid, doc_id of each document whose text holds a query's text, letter for letter.

    The different passages go to the documents in blocks of _PASSAGES bytes, as an Aho-Corasick automaton, of some 50 bytes
    for a byte of passages, that reads each text once; no document is shuffled. An empty passage is in every text, a null one in none.
    """
    spark = docs.sparkSession
    own = passages.select("qid", "text").filter(F.col("text").isNotNull())
    kinds = StructType([docs.schema["doc_id"]]).add("passage", "string")
    out = spark.createDataFrame([], kinds)
    for block in in_blocks(own.select("text").distinct(), F.octet_length("text") + 16, _PASSAGES):
        sent = spark.sparkContext.broadcast([r.text for r in block])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            asked = [t for t in sent.value if t]
            always = [""] * (len(asked) < len(sent.value))
            machine = ahocorasick.Automaton()
            for text in asked:
                machine.add_word(text, text)
            if asked:
                machine.make_automaton()
            for batch in batches:
                rows: list[int] = []
                found: list[str] = []
                for j, text in enumerate(batch.column("text").to_pylist()):
                    if text is not None:
                        held = [*always, *({t for _, t in machine.iter(text)} if asked else ())]
                        rows += [j] * len(held)
                        found += held
                ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.string())], names=["doc_id", "passage"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, kinds))
    return out.join(own, F.col("passage") == F.col("text")).select("qid", "doc_id")


def _first_of(ctx: DataFrame, key: Column) -> DataFrame:
    w = Window.partitionBy("qid", key).orderBy("rank")
    return ctx.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def dedupe_by_prefix(ctx: DataFrame) -> DataFrame:
    """Of the first five contexts those of 20 characters or more, the first of each 200-character prefix."""
    own = ctx.filter((F.col("rank") <= FOR_ANSWER) & (F.length(strip(F.col("context"))) >= 20))
    return _first_of(own, F.substring("context", 1, 200))


def fingerprint(text: Column) -> Column:
    """The sorted set of the first 20 words."""
    return F.array_join(F.array_sort(F.array_distinct(F.slice(ws_tokens(text), 1, 20))), " ")


def dedupe_by_fingerprint(ctx: DataFrame) -> DataFrame:
    """Of the first four contexts the first of each fingerprint."""
    return _first_of(ctx.filter(F.col("rank") <= FOR_FINGERPRINT), fingerprint(F.col("context")))


def gathered(queries: DataFrame, ctx: DataFrame) -> DataFrame:
    """qid, query, contexts by rank; queries without any have an empty array. At most ten rows a query meet."""
    by_rank = F.array_sort(F.collect_list(F.struct("rank", "context")))
    own = ctx.groupBy("qid").agg(F.transform(by_rank, lambda c: c["context"]).alias("contexts"))
    q = queries.select("qid", F.col("text").alias("query")).join(own, "qid", "left")
    return q.withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))


def _candidates(longest: int) -> Column:
    """All sentences of fit length, in order of context and place."""
    all_ = F.flatten(F.transform("contexts", sentences))
    return F.filter(all_, lambda s: (F.length(s) >= 10) & (F.length(s) <= 2 * longest))


def _best(q: DataFrame, score) -> DataFrame:
    """The sentence of the highest score above 0, the earliest of equals: a fold over the candidates."""
    scored = F.transform("_s", lambda s: F.struct(score(s).alias("score"), s.alias("s")))
    zero = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("s"))
    best = F.aggregate(scored, zero, lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    return q.withColumn("_best", best["s"])


def _overlap(s: Column) -> Column:
    return F.size(F.array_intersect(F.col("_q"), tokens(s))).cast("double")


def extractive(q: DataFrame, longest: int = 500) -> DataFrame:
    """The sentence that shares most words with the query; else the first context, cut."""
    d = q.withColumns({"_q": F.array_distinct(tokens(F.col("query"))), "_s": _candidates(longest)})
    d = _best(d, _overlap)
    first = F.get("contexts", F.lit(0))
    answer = F.when(F.size("contexts") == 0, NO_CONTEXT).otherwise(F.coalesce(clipped(F.col("_best"), longest), clipped(first, longest, always=True)))
    return d.select("qid", answer.alias("answer"))


def extractive_weighted(q: DataFrame, longest: int = 200) -> DataFrame:
    """Overlap share 0.7, moderate length 0.2, and a constant 0.1; long sentences are cut by words."""
    d = q.withColumn("contexts", F.slice("contexts", 1, FOR_ANSWER))
    d = d.withColumns({"_q": F.array_distinct(tokens(F.col("query"))), "_s": _candidates(longest)})

    def score(s: Column) -> Column:
        share = F.when(F.size("_q") > 0, _overlap(s) / F.size("_q")).otherwise(0.0)
        return F.round(share * 0.7 + F.least(F.lit(1.0), 50 / F.size(ws_tokens(s, lower=False))) * 0.2 + 0.1, 9)

    d = _best(d, score)
    short = F.concat(F.array_join(F.slice(ws_tokens(F.col("_best"), lower=False), 1, longest // 8), " "), F.lit("..."))
    best = F.when(F.length("_best") > longest, short).otherwise(F.col("_best"))
    answer = F.when(F.size("contexts") == 0, NO_CONTEXT).otherwise(F.coalesce(best, clipped(F.get("contexts", F.lit(0)), longest)))
    return d.select("qid", answer.alias("answer"))


def first_context(q: DataFrame, longest: int = 200) -> DataFrame:
    """The first context, cut."""
    first = F.get("contexts", F.lit(0))
    return q.select("qid", F.coalesce(clipped(first, longest), F.lit(NO_ANSWER)).alias("answer"))


def generative(q: DataFrame, longest: int = 500) -> DataFrame:
    """A template by question words over the joined contexts."""
    ctx = F.substring(F.array_join("contexts", " | "), 1, longest)
    lead = F.when(has_any(F.col("query"), "what", "who"), INFORMATION).when(has_any(F.col("query"), "how", "why"), EXPLANATION).otherwise(CONTEXT)
    return q.select("qid", F.when(F.size("contexts") == 0, NO_CONTEXT).otherwise(F.concat(lead, ctx)).alias("answer"))


def _by_question(q: DataFrame, ctx: Column) -> DataFrame:
    """Six templates by question words over ctx, the contexts combined."""
    asked = F.col("query")
    lead = (
        F.when(has_any(asked, "what", "which", "who") & has_any(asked, "definition", "meaning"), DEFINITION)
        .when(has_any(asked, "what", "which", "who"), SOURCES)
        .when(has_any(asked, "how", "why"), EXPLANATION)
        .when(has_any(asked, "when", "where"), INDICATION)
        .when(has_any(asked, "is", "are", "does", "do", "can", "will"), AVAILABLE)
        .otherwise(GENERAL)
    )
    answer = F.when(F.size("contexts") == 0, NO_CONTEXT).when(F.length(strip(ctx)) == 0, NOT_RELEVANT).otherwise(F.concat(lead, ctx))
    return q.select("qid", answer.alias("answer"))


def generative_smart(q: DataFrame, longest: int = 800) -> DataFrame:
    """By question, over contexts that are cut at a sentence."""
    return _by_question(q, cut_at_sentence(F.array_join("contexts", " | "), longest))


def generative_simple(q: DataFrame, longest: int = 800) -> DataFrame:
    """By question, over the first two contexts."""
    return _by_question(q, F.substring(F.array_join(F.slice("contexts", 1, 2), " "), 1, longest))


def placeholder(q: DataFrame, model: str) -> DataFrame:
    """What stands in for a language model: no model is called."""
    return q.select("qid", F.concat(F.lit(f"[{model}] "), F.col("query"), F.format_string(" (%d contexts)", F.size("contexts"))).alias("answer"))
