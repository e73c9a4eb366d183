"""Boolean retrieval in relational form: each operator is a join or set operation on doc_id.

The query language compiles to one aggregation instead (plans/query.py); these are its parts on their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term(postings: DataFrame, word: str) -> DataFrame:
    return postings.where(F.col("term") == word).select("doc_id")


def all_of(postings: DataFrame, words: list[str]) -> DataFrame:
    """Documents with every word: one aggregation by document."""
    words = sorted(set(words))
    return postings.where(F.col("term").isin(words)).groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(words)).select("doc_id")


def any_of(postings: DataFrame, words: list[str]) -> DataFrame:
    return postings.where(F.col("term").isin(words)).select("doc_id").distinct()


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("doc_id").distinct(), "doc_id", "left_semi")


def either(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select("doc_id") for p in parts]).distinct()


def without(base: DataFrame, excluded: DataFrame) -> DataFrame:
    return base.join(excluded.select("doc_id"), "doc_id", "left_anti")


def phrase(postings: DataFrame, words: list[str]) -> DataFrame:
    """Documents with the words in a row: positions less their place in the phrase must meet."""
    place = F.explode(F.array(*(F.struct(F.lit(w).alias("term"), F.lit(k).alias("k")) for k, w in enumerate(words))))
    wanted = postings.sparkSession.range(1).select(place.alias("p")).select("p.*")
    rows = postings.where(F.col("term").isin(words)).join(F.broadcast(wanted), "term")
    starts = rows.select("doc_id", "k", F.explode("positions").alias("pos")).select("doc_id", (F.col("pos") - F.col("k")).alias("start"))
    return starts.groupBy("doc_id", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(words)).select("doc_id").distinct()


def dedup(matches: DataFrame) -> DataFrame:
    return matches.dropDuplicates(["doc_id"])


def match_count(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count("*").alias("n_matches"))
