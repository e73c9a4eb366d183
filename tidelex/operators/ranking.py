"""Ranking: TF-IDF, a static score, and bonuses for terms in title and URL.

    score = tfidf_weight * sum(count * idf * tf / length) + static_weight * static
          + title_weight * (terms in the title's tokens) + url_weight * (terms inside the lower-cased URL)
with idf = ln(N / df) + 1e-9. Scores are rounded to six digits, and ties go by doc_id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelex.functions.text import lower_ascii, tokenize

EPSILON = 1e-9
DIGITS = 6


@dataclass(frozen=True)
class RankWeights:
    tfidf: float = 1.0
    static: float = 2.0
    title: float = 1.5
    url: float = 0.5


def idf(df: int, n: int) -> float:
    return math.log(max(1, n) / df) + EPSILON if df else 0.0


def idf_column(df: Column, n: Column) -> Column:
    return F.log(F.greatest(F.lit(1), n) / df) + F.lit(EPSILON)


def title_bonus(title: Column, counts: dict[str, int], options=None) -> Column:
    words = tokenize(title, options) if options is not None else tokenize(title)
    return sum((F.when(F.array_contains(words, t), c).otherwise(0) for t, c in counts.items()), F.lit(0)).cast("double")


def url_bonus(url: Column, counts: dict[str, int]) -> Column:
    low = lower_ascii(F.coalesce(url, F.lit("")))
    return sum((F.when(low.contains(t), c).otherwise(0) for t, c in counts.items()), F.lit(0)).cast("double")


def rank(index, query, weights: RankWeights = RankWeights()) -> DataFrame:
    """All matches with their scores. Only matches are joined with the documents' columns."""
    counts = query.counts
    df = index.document_frequency(list(counts)) if counts else {}
    n = index.size()
    matches = query.matches(index.postings)
    hits = matches.join(index.docs.select("doc_id", "url", "title", "length"), "doc_id")
    length = F.greatest(F.lit(1), F.col("length"))
    tfidf = sum((F.col(f"tf_{k}") / length * F.lit(c * idf(df[t], n)) for k, (t, c) in enumerate(counts.items())), F.lit(0.0))
    if index.pagerank is not None:
        hits = hits.join(index.pagerank.withColumnRenamed("score", "static"), "doc_id", "left").withColumn("static", F.coalesce("static", F.lit(0.0)))
    else:
        hits = hits.withColumn("static", F.lit(0.0))
    hits = hits.withColumns({"tfidf": tfidf, "title_bonus": title_bonus(F.col("title"), counts, index.options), "url_bonus": url_bonus(F.col("url"), counts)})
    score = weights.tfidf * F.col("tfidf") + weights.static * F.col("static") + weights.title * F.col("title_bonus") + weights.url * F.col("url_bonus")
    return hits.select("doc_id", F.round(score, DIGITS).alias("score"), F.round("tfidf", DIGITS).alias("tfidf"), "title_bonus", "url_bonus", "url", "title")
