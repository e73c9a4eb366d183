"""Snippets: the window of tokens with most query words, as collapsed text. All of it happens within a document's row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelex.functions.text import collapse_whitespace, token_segments

WINDOW, FALLBACK = 25, 240


def token_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, word, start, end): character offsets of each raw token of (doc_id, text)."""
    rows = docs.select("doc_id", F.posexplode(token_segments(F.col("text"))).alias("pos", "segment"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("segment")).over(w).cast("int")
    word = F.regexp_extract("segment", "([A-Za-z0-9]+)$", 1)
    return rows.select("doc_id", "pos", "segment", end.alias("end")).select("doc_id", "pos", F.lower(word).alias("word"), (F.col("end") - F.length(word)).alias("start"), "end")


def _windows(docs: DataFrame, terms: list[str], window: int) -> DataFrame:
    """The columns of docs with n_tokens, first, last, hits, from and to; null ones where a text has no token.

    The earliest window with most hits ends at a hit or begins with the text: moving it left to its last hit loses none. So
    only the hits' positions are looked at, each with as many hits before it as a window can hold.
    """
    words = [t for t in terms if t]
    width = f"least({window}, n_tokens)" if window else "n_tokens"
    at = docs.withColumn("segments", token_segments(F.col("text"))).withColumn("n_tokens", F.size("segments"))
    hit = lambda s, i: F.when(F.lower(F.regexp_extract(s, "([A-Za-z0-9]+)$", 1)).isin(words), i)
    at = at.withColumn("places", F.filter(F.transform("segments", hit), lambda i: i.isNotNull()) if words else F.array().cast("array<int>"))
    seen = f"size(filter(slice(places, greatest(1, k + 2 - {width}), least(k + 1, {width})), q -> q > p - {width}))"
    best = f"array_max(transform(places, (p, k) -> named_struct('hits', {seen}, 'first', -greatest(0, p - {width} + 1))))"
    at = at.withColumn("best", F.expr(f"IF(n_tokens = 0, NULL, coalesce({best}, named_struct('hits', 0, 'first', 0)))"))
    at = at.select(*docs.columns, "segments", "n_tokens", F.col("best.hits").alias("hits"), (-F.col("best.first")).alias("first")).withColumn("last", F.expr(f"first + {width} - 1"))
    long = "aggregate(slice(segments, {0}, {1}), 0, (a, s) -> a + length(s))"
    begin = F.expr(long.format(1, "first + 1")) - F.length(F.regexp_extract(F.expr("segments[first]"), "([A-Za-z0-9]+)$", 1))
    return at.withColumns({"from": begin, "to": F.expr(long.format(1, "last + 1"))}).drop("segments")


def best_windows(docs: DataFrame, terms: list[str], window: int = WINDOW) -> DataFrame:
    """(doc_id, first, last, n_tokens, hits, from, to): the earliest full window with most hits."""
    return _windows(docs.select("doc_id", "text"), terms, window).where("n_tokens > 0").select("doc_id", *(F.col(c).cast("int").alias(c) for c in ("first", "last", "n_tokens", "hits", "from", "to")))


def snippets(docs: DataFrame, terms: list[str], window: int = WINDOW) -> DataFrame:
    """(doc_id, snippet) of (doc_id, text)."""
    body = collapse_whitespace(F.substring(F.col("text"), F.col("from") + 1, F.col("to") - F.col("from")))
    made = F.concat(F.when(F.col("first") > 0, "... ").otherwise(""), body, F.when(F.col("last") + 1 < F.col("n_tokens"), " ...").otherwise(""))
    fallback = collapse_whitespace(F.substring(F.coalesce("text", F.lit("")), 1, FALLBACK))
    return _windows(docs.select("doc_id", "text"), terms, window).select("doc_id", F.coalesce(made, fallback).alias("snippet"))
