"""Incremental ingest: new pages arrive as files, urls are deduplicated with state, postings are appended by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.functions.text import AnalyzerOptions
from tidelex.plans.index import postings_of, tokens
from tidelex.sources.corpus import pages_corpus

PAGES = "page_id long, url string, html string"


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PAGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def ingest(pages: DataFrame, index_folder: str, checkpoint: str, options: AnalyzerOptions = AnalyzerOptions()):
    """Append the documents and postings of a stream of pages, each url once, until the source is used up.

    A batch is written below its own number and overwrites what a failed attempt left, so a restart adds nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        corpus, _ = pages_corpus(batch)
        corpus = corpus.persist()
        corpus.select("doc_id", "url", "path", "title", "text").write.mode("overwrite").parquet(f"{index_folder}/docs/batch={number}")
        postings = postings_of(tokens(corpus, options))
        postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{index_folder}/postings/batch={number}")
        corpus.unpersist()

    once = pages.where(F.col("url").isNotNull()).dropDuplicates(["url"])
    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
