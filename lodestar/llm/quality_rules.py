"""Quality rules: a threshold table compiled into one native Spark projection.

Words are maximal runs of non-white-space (space, \\t, \\n, \\v, \\f, \\r separate).
A null or empty text has no words; every count is 0 and it fails the base rule.
Repeated rows are judged alike, whatever their id. Texts of any length are judged whole, and none
fails for being long. The stop words are of English, French, German and Spanish: texts in other languages without
any of them fail by the stop-word ratio. Null ids are ids like others. An empty table gives an empty one. Columns of the input that are not asked for are
not read, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it was on with as are be this by from or an at not have "
    "de la le et les des en un une du que qui dans est pour sur par au pas avec "
    "der die und das den von zu mit ist für auf eine ein dem nicht als auch im "
    "el los las y se del por con una su para como"
).split()


@dataclass(frozen=True)
class Rule:
    """metric must lie in [low, high]; a missing bound is open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are shares of words, lines or characters.
RULES = (
    Rule("length", "n_words", low=50),
    Rule("mean_word_length", "mean_word_chars", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.10),
    Rule("stop_words", "stop_word_ratio", low=0.005),
    Rule("duplicate_lines", "dup_line_ratio", high=0.50),
    Rule("repeated_words", "repeat_word_ratio", high=0.50),
)


def _pairs(arr: Column, n: Column, f) -> Column:
    """f over neighbours of arr, which has n elements."""
    k = F.greatest(n - 1, F.lit(0))
    return F.zip_with(F.slice(arr, F.lit(1), k), F.slice(arr, F.lit(2), k), f)


def measures(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """keep and the metrics of RULES; only native expressions, one pass, no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    word_lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(*keep, t.alias("_t"), F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_w"), word_lines.alias("_l"))
    k = F.greatest(F.size("_w") - 2, F.lit(0))
    second = F.zip_with(F.slice("_w", F.lit(1), k), F.slice("_w", F.lit(2), k), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = F.zip_with(second, F.slice("_w", F.lit(3), k), lambda a, b: F.concat(a, F.lit(" "), b))
    d = d.withColumn("_s", F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    # of sorted windows, those equal to a neighbour occur twice or more
    d = d.withColumn("_e", _pairs(F.col("_s"), F.size("_s"), lambda a, b: a["g"] == b["g"]))
    no = F.array(F.lit(False))
    twice = F.zip_with(F.concat(no, F.col("_e")), F.concat(F.col("_e"), no), lambda a, b: a | b)
    starts = F.filter(F.zip_with(F.col("_s"), twice, lambda s, y: F.when(y, s["i"])), lambda x: x.isNotNull())
    d = d.withColumn("_p", F.sort_array(starts))
    # words covered by windows at sorted starts p: 3 each, less what the next one covers too
    covered = F.aggregate(_pairs(F.col("_p"), F.size("_p"), lambda a, b: F.least(b - a, F.lit(3))), F.lit(3), lambda a, x: a + x)
    stop = F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))
    d = d.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_p") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size(stop).cast("long").alias("n_stop_words"),
    )

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return d.withColumns({
        "mean_word_chars": share("word_chars", "n_words"),
        "symbol_ratio": share("n_symbols", "word_chars"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"),
        "repeat_word_ratio": share("n_repeat_words", "n_words"),
        "stop_word_ratio": share("n_stop_words", "n_words"),
    })


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule holds; the table becomes one conjunction."""
    ok = F.lit(True)
    for r in rules:
        if r.low is not None:
            ok = ok & (F.col(r.metric) >= r.low)
        if r.high is not None:
            ok = ok & (F.col(r.metric) <= r.high)
    return ok


def apply_rules(docs: DataFrame, *keep: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """keep, the metrics, base_failed, kept."""
    d = measures(docs, *keep).withColumn("base_failed", base_failed())
    return d.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs, with their columns, that the rules keep.

    The condition stands on a generator, which the optimiser doesn't copy
    into the projections below it: each metric is computed once per row.
    """
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    judged = apply_rules(boxed.select("_row", F.col("_row.text").alias("text")), "_row", rules=rules)
    one = F.explode(F.when(F.col("kept"), F.array(F.col("_row"))).otherwise(F.array().cast(f"array<{judged.schema['_row'].dataType.simpleString()}>")))
    return judged.select(one.alias("_row")).select("_row.*")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    d = apply_rules(table(spark, sf_dir, "documents"), "doc_id")
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), p AS (
  SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3) AS gap
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1
), r AS (SELECT doc_id, sum(least(gap, 3)) AS n FROM p GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL})))::BIGINT AS n_stop_words
  FROM d LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND word_chars / n_words >= 2 AND word_chars / n_words <= 15
         AND CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END <= 0.1
         AND n_stop_words / n_words >= 0.005
         AND CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END <= 0.5
         AND n_repeat_words / n_words <= 0.5 AS kept
FROM m
"""
