"""Tokens, stop words, stems and escapes as native Column expressions.

Character classes are ASCII on purpose: a token is a run of ``[A-Za-z0-9]``. In ``tokenize`` an apostrophe after a
token character is dropped and joins; in ``token_spans`` it splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words and the suffixes, in the order in which they are tried.
STOP_WORDS = (
    "a about an and are as at be but by can could did do does for from had has have he her his how i if in into is it its "
    "not of on or should so than that the their then there these they this those to was we were what when where which who "
    "whom why will with would you your"
).split()
SUFFIXES = "ational tional izer ation ing edly ies ed es ly s".split()

STEM_PATTERN = "^(.{3,}?)(?:" + "|".join(SUFFIXES) + ")$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class AnalyzerOptions:
    """How text becomes tokens. Stored with an index, so that queries use the same."""

    stop_words: bool = False
    stem: bool = False
    min_length: int = 1


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def stem(word: Column) -> Column:
    """Strip the first suffix that leaves three characters or more."""
    return F.regexp_replace(word, STEM_PATTERN, "$1")


def is_stop_word(word: Column) -> Column:
    return word.isin(STOP_WORDS)


def tokenize(text: Column, options: AnalyzerOptions = AnalyzerOptions()) -> Column:
    """array<string>; empty for null."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), "([A-Za-z0-9])'+", "$1")
    words = F.transform(F.regexp_extract_all(joined, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    if options.min_length > 1:
        words = F.filter(words, lambda w: F.length(w) >= options.min_length)
    if options.stop_words:
        words = F.filter(words, lambda w: ~is_stop_word(w))
    return F.transform(words, stem) if options.stem else words


def normalize_word(text: Column, options: AnalyzerOptions = AnalyzerOptions()) -> Column:
    """The first token, or an empty string."""
    return F.coalesce(F.get(tokenize(text, options), F.lit(0)), F.lit(""))


def token_segments(text: Column) -> Column:
    """Each token with what stands before it; lengths add up to token ends."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^A-Za-z0-9]*[A-Za-z0-9]+"), F.lit(0))


def collapse_whitespace(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, "[ \\t\\n\\r]+", " "), F.lit(" "))


def html_escape(c: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def sanitize_tsv(c: Column) -> Column:
    return F.translate(c, "\t\n\r", "   ")


def zero_padded(number: Column, width: int = 8) -> Column:
    """Padded to ``width`` digits, never cut."""
    return F.format_string(f"%0{width}d", number)


def trim_blank(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\r\n"))


def url_decode(c: Column) -> Column:
    """``%hh`` and ``+``; a malformed escape stays as it is."""
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def highlight(snippet: Column, terms: list[str]) -> Column:
    """Escape a snippet and mark tokens that equal, begin with, or begin a term."""
    terms = [t for t in terms if t]

    def piece(p: Column) -> Column:
        word = F.lower(p)
        hit = F.lit(False)
        for t in terms:
            hit = hit | word.startswith(t) | F.lit(t).startswith(word)
        return F.when(p.rlike("^[A-Za-z0-9]") & hit, F.concat(F.lit("<mark>"), p, F.lit("</mark>"))).otherwise(html_escape(p))

    return F.array_join(F.transform(F.regexp_extract_all(snippet, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0)), piece), "")
