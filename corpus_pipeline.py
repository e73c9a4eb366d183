"""The corpus pipeline: language ID, quality, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.llm import language_id, quality
from tidelex.llm.ngram_join import ngram_components
from tidelex.llm.packing import pack
from tidelex.llm.queries import vocabulary
from tidelex.llm.shared import new_path, scratch
from tidelex.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bits a symbol from which a text is in none of the languages learned; more for those whose own text costs more.
MOST_COST = 8.0
#: Near-duplicates share this much of their distinct word shingles.
NEAR_WORDS, NEAR_NUMERATOR, NEAR_DENOMINATOR = 5, 4, 5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter (null and empty ones too), or that no learned language explains, go. Columns beyond those of documents
    are dropped here and in the stages after it."""
    docs = docs.select(*COLUMNS)
    texts = language_id.fit(docs)
    out = language_id.identify(docs, texts, COLUMNS)
    most = F.lit(MOST_COST)
    for name, cost in language_id.most_costs(texts, MOST_COST).items():
        most = F.when(F.col("lang_pred") == name, cost).otherwise(most) if cost > MOST_COST else most
    return out.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("cost") <= most)).select(*COLUMNS)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score below one half go; null and empty texts are judged by the bias alone. Without any label all stay, at one half."""
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, COLUMNS).where("score >= 0.5").select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts linked at 5-word Jaccard >= 0.8 the smallest doc_id stays, in one row. Rows without doc_id stay."""
    docs = docs.select(*COLUMNS)
    first = ngram_components(docs, NEAR_WORDS, NEAR_NUMERATOR, NEAR_DENOMINATOR).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a smaller doc_id has go; every document stays, if with less text."""
    out = substring_dedup(docs, with_text=True, carry=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(changed, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents; null and empty texts are their end id alone."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("quality_classifier", keep_good_quality),
    ("ngram_join", keep_one_of_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: Models are learned on the way, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. A stage's own tables go when its result is written, that result stays: the last one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
