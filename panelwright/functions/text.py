"""Text functions as column expressions; each has the meaning of the Python string method it names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() takes off at either end.
_STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: Summaries in the order in which one stands in for a missing body.
SUMMARIES = ("summary_textrank", "summary_lsa", "summary_luhn", "summary_lexrank")


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(column(c), _STRIP, "")


def or_empty(c: Column | str) -> Column:
    return F.coalesce(column(c), F.lit(""))


def optional(c: Column | str) -> Column:
    """The stripped text; null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def key(c: Column | str) -> Column:
    """The form in which codes are looked up: stripped, upper case, never null."""
    return F.upper(strip(or_empty(c)))


def normalized_alias(c: Column | str) -> Column:
    """Lower case; & becomes the word and; everything but a-z and 0-9 separates words; one blank between words."""
    return F.trim(F.regexp_replace(F.replace(F.lower(column(c)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def without_suffixes(name: Column | str, suffixes: list[str]) -> Column:
    """The words [A-Za-z0-9&]+ of a name, joined by blanks, up to the last that is no corporate suffix."""
    words = F.regexp_extract_all(column(name), F.lit("[A-Za-z0-9&]+"), F.lit(0))
    place = F.transform(words, lambda w, i: F.when(F.lower(w).isin(suffixes), F.lit(0)).otherwise(i + 1)) if suffixes else F.transform(words, lambda w, i: i + 1)
    return F.array_join(F.slice(words, 1, F.coalesce(F.array_max(place), F.lit(0))), " ")


def without_punctuation(name: Column | str) -> Column:
    """Everything but letters, digits and & becomes one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(column(name), "[^A-Za-z0-9& ]+", " "), r"\s+", " "))


def distinct_texts(values: Column | str) -> Column:
    """Stripped non-empty texts of an array, each once, in order of appearance; empty for null."""
    kept = F.filter(F.transform(column(values), strip), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def digest(c: Column | str) -> Column:
    return F.sha2(F.encode(column(c), "UTF-8"), 256)


def month(c: Column | str) -> Column:
    """yyyy-MM of an ISO date text."""
    return F.substring(column(c), 1, 7)


def joined(columns: list[str]) -> Column:
    return F.concat_ws(" ", *[or_empty(c) for c in columns])


def article(max_chars: int = 4000) -> Column:
    """Title and body, or the first summary there is, a line each, cut after max_chars code points."""
    title, body = strip(or_empty("title")), strip(or_empty("body"))
    summary = F.coalesce(*[optional(c) for c in SUMMARIES])
    rest = F.when(body != "", F.concat(F.lit("Body: "), body)).when(summary.isNotNull(), F.concat(F.lit("Summary: "), summary))
    return F.substring(strip(F.concat_ws("\n", F.when(title != "", F.concat(F.lit("Title: "), title)), rest)), 1, max_chars)


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)
