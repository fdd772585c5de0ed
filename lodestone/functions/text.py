"""Text functions as column expressions; the two that Spark has no expression for are Arrow functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions import vocab

WORD = r"([\p{L}\p{N}_]+)"


@F.pandas_udf(StringType())
def fold_case(text: pd.Series) -> pd.Series:
    """NFKD form in lower case, trimmed; null becomes an empty text."""
    return text.map(lambda t: "" if t is None else unicodedata.normalize("NFKD", t).lower().strip())


#: White space of any kind, no-break spaces too.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """Without white space around it."""
    return F.btrim(text, F.lit(SPACES))


def fold_ascii(text: Column) -> Column:
    """Lower case, trimmed; enough where no compatibility forms occur, and stays in the JVM."""
    return F.lower(strip(F.coalesce(text, F.lit(""))))


def normalize(text: Column) -> Column:
    """Lower case with single spaces."""
    return strip(F.regexp_replace(fold_ascii(text), r"\s+", " "))


def listed(words_: list[str] | tuple[str, ...] | str) -> Column:
    """A constant array of words; one expression to build, folded to a literal by the optimizer."""
    joined = words_ if isinstance(words_, str) else "\u0001".join(words_)
    return F.split(F.lit(joined), " " if isinstance(words_, str) else "\u0001")


def words(text: Column) -> Column:
    """The analyzer: runs of letters, digits and underscores of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def store_tokens(text: Column) -> Column:
    """Split at white space, punctuation stays attached."""
    return F.filter(F.split(normalize(text), " "), lambda w: w != "")


def index_tokens(text: Column) -> Column:
    """Split at white space and the usual punctuation, in lower case."""
    return F.filter(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), ".,!?;:()\"'", " " * 10), r"\s+"), lambda w: w != "")


def keywords(text: Column) -> Column:
    """The distinct words that are no stop words, in order."""
    stop = listed(vocab.STOPWORDS)
    return F.array_distinct(F.filter(words(text), lambda w: ~F.array_contains(stop, w)))


def quoted_phrases(text: Column) -> Column:
    """The texts between double quotes."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit('"([^"]*)"'), F.lit(1))


def entities(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Maximal runs of capitalised words, trimmed of punctuation; distinct, in order."""
    stop = listed(stopwords) if stopwords else F.array().cast("array<string>")
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, r"""^[.,!?()\[\]{}"']+|[.,!?()\[\]{}"']+$""", ""))
    parts = F.filter(trimmed, lambda w: w != "")

    def capital(w: Column) -> Column:
        first = F.substring(w, 1, 1)
        upper = (w == F.upper(w)) & (w != F.lower(w))
        return (upper & (F.length(w) >= 2)) | ((first != F.lower(first)) & ~upper)

    # a word outside a run becomes a separator, so a run is what stands between separators
    marked = F.array_join(F.transform(parts, lambda w: F.when(capital(w), w).otherwise(F.lit("\u0001"))), " ")
    runs = F.transform(F.split(marked, "\u0001"), strip)
    return F.array_distinct(F.filter(runs, lambda r: (F.length(r) > 1) & ~F.array_contains(stop, F.lower(r))))


def clean_value(value: Column) -> Column:
    """Without surrounding space, closing punctuation and a leading article."""
    return F.regexp_replace(F.regexp_replace(strip(value), r"[.,!?;:]+$", ""), r"(?i)^(?:a|an|the)\s+", "")


def fact(text: Column) -> Column:
    """struct(subject, attribute, value) of the first sentence pattern that gives both parts; null if none."""
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    out = F.lit(None)
    for attribute, pattern in reversed(vocab.FACTS):
        subject = clean_value(F.regexp_extract(stripped, "(?i)" + pattern, 1))
        value = clean_value(F.regexp_extract(stripped, "(?i)" + pattern, 2))
        found = F.struct(subject.alias("subject"), F.lit(attribute).alias("attribute"), value.alias("value"))
        out = F.when((subject != "") & (value != ""), found).otherwise(out)
    return out


def flags(text: Column) -> dict[str, Column]:
    """Length, number of words, and what a text contains."""
    return {
        "n_length": F.length(text).cast("long"),
        "word_count": F.size(store_tokens(text)).cast("long"),
        "contains_number": F.rlike(text, F.lit("[0-9]")),
        "contains_url": F.rlike(text, F.lit(r"https?://|www\.")),
        "contains_email": F.rlike(text, F.lit(r"[^\s]+@[^\s]+")),
        "contains_question": F.contains(text, F.lit("?")),
        "contains_code": F.rlike(text, F.lit(r"[{};]|def\s+|class\s+|return\s+|import\s+")),
    }


def has_importance_cue(text: Column) -> Column:
    return F.rlike(F.lower(text), F.lit(r"\b(" + "|".join(re.escape(p) for p in vocab.IMPORTANCE_PHRASES).replace("\\ ", " ") + r")\b"))


def token_estimate(text: Column) -> Column:
    """About four characters a token; 0 for an empty or null text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")


def truncate(text: Column, max_tokens: int) -> Column:
    """At most max_tokens by the estimate, cut at the last space if that keeps over 80 %, with an ellipsis."""
    limit = max_tokens * 4
    head = F.substring(text, 1, limit)
    # characters before the last space
    before = F.lit(limit) - F.locate(" ", F.reverse(head))
    cut = F.when(F.contains(head, F.lit(" ")) & (before > limit * 0.8), F.substr(head, F.lit(1), before)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("...")))


def attribute_of(text: Column, substring: bool = False, tokens: Column | None = None) -> Column:
    """The first attribute, in order, one of whose words occurs; as a whole word by default. tokens: the text's words, if at hand."""
    found = words(text) if tokens is None else tokens
    out = F.lit(None).cast("string")
    for name, _, aliases in reversed(vocab.ATTRIBUTES):
        each = aliases.split()
        hit = (
            F.greatest(*[F.contains(F.lower(text), F.lit(a)) for a in each])
            if substring
            else F.arrays_overlap(found, listed(aliases))
        )
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def prompt(system: Column, context: Column, user: Column) -> Column:
    """A chat prompt of a system text, the retrieved context and the question."""
    return F.concat_ws("\n", F.concat(F.lit("[system] "), system), F.concat(F.lit("[context] "), context), F.concat(F.lit("[user] "), user), F.lit("[assistant]"))
