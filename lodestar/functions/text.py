"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a maximal run of letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"
#: Fixed value: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(text: Column) -> Column:
    """Lower-cased words, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def ws_tokens(text: Column, lower: bool = True) -> Column:
    """Runs of non-white-space."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(F.lower(t) if lower else t, F.lit(r"\S+"), F.lit(0))


def normalised(text: Column) -> Column:
    """For metrics: lower case, no ASCII punctuation, single spaces."""
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def metric_tokens(text: Column) -> Column:
    return F.filter(F.split(normalised(text), " "), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Pieces between runs of . ! and ?, stripped; empty pieces stay, so that places count."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), strip)


def clipped(text: Column, most: int, always: bool = False) -> Column:
    """The first `most` characters, with an ellipsis where something was cut, or always."""
    cut = F.concat(F.substring(text, 1, most), F.lit("..."))
    return cut if always else F.when(F.length(text) > most, cut).otherwise(text)


def cut_at_sentence(text: Column, most: int) -> Column:
    """At most `most` characters; where a full stop lies in the last fifth, up to it."""
    head = F.substring(text, 1, most)
    dot = most - F.locate(".", F.reverse(head)) + 1
    last = F.when(F.locate(".", head) > 0, dot).otherwise(0)
    return F.when(F.length(text) <= most, text).when(last - 1 > most * 0.8, F.substring(head, F.lit(1), last)).otherwise(head)


def has_any(text: Column, *words: str) -> Column:
    """Any of words is a substring of the lower-cased text."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower(text), F.lit(w))
    return found


def question_type(query: Column) -> Column:
    return F.when(has_any(query, "what", "who"), "information").when(has_any(query, "how", "why"), "explanation").otherwise("general")


def first_text(*candidates: Column) -> Column:
    """The first candidate that is neither null nor blank, stripped."""
    return F.coalesce(*[F.nullif(strip(c.cast("string")), F.lit("")) for c in candidates])


def titled(title: Column, text: Column) -> Column:
    """Title and text as one, stripped."""
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))


def size_estimate(doc_id: Column, text: Column, title: Column, metadata: Column) -> Column:
    """Bytes a cached document takes: four per character of its fields."""
    parts = [F.coalesce(F.length(c.cast("string")), F.lit(0)) for c in (doc_id, text, title, metadata)]
    return 4 * sum(parts[1:], parts[0])


def build_time_estimate(n_docs: Column, per_second: float) -> Column:
    """~Ns, ~Nm or ~NhNm at a rate of documents per second."""
    minutes = n_docs / per_second / 60
    return (
        F.when(minutes < 1, F.format_string("~%ds", F.floor(minutes * 60)))
        .when(minutes < 60, F.format_string("~%dm", F.floor(minutes)))
        .otherwise(F.format_string("~%dh%dm", F.floor(minutes / 60), F.floor(minutes % 60)))
    )
