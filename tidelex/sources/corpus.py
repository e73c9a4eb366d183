"""Corpora from folders, manifests, seed lists and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelex.functions.html import html_links, html_text, html_title
from tidelex.functions.text import sanitize_tsv, zero_padded
from tidelex.storage import stored

# Files of a crawl folder that are no documents, and extensions of HTML.
NOT_DOCUMENTS = ("manifest.tsv", "frontier.txt", "seen.txt")
HTML_EXTENSIONS = (".html", ".htm")
MANIFEST = "id long, rel_path string, url string, title string, outlinks string"


def is_html(path):
    return F.lower(F.regexp_extract(path, "(\\.[^./]*)$", 1)).isin(*HTML_EXTENSIONS)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, path, raw): each regular file below a folder, numbered by the order of its path's components.

    Numbers come from one sort by path: ranges of the sorted paths are counted, then numbered within each.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    files = files.where(~name.isin(*NOT_DOCUMENTS)).select("path", F.decode("content", "UTF-8").alias("raw"))
    return number(files, F.split("path", "/"))


def number(rows: DataFrame, *order, name: str = "doc_id") -> DataFrame:
    """Dense numbers from 0 in an order. Rows are range-partitioned by it and written with their partition's number, so that counting
    and numbering see the same partitions; only the counts, one row a partition, meet in one place."""
    keyed = rows.withColumns({f"__k{i}": c for i, c in enumerate(order)})
    keys = [f"__k{i}" for i in range(len(order))]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(keyed.repartitionByRange(parts, *keys).withColumn("__p", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*keys))
    out = ranged.join(F.broadcast(before), "__p").withColumn(name, (F.col("__before") + place - 1).cast("long"))
    return out.select(name, *rows.columns)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(rel_path, id, url, title, outlinks array): rows with 5 fields; of rows for one file the last holds."""
    raw = spark.read.option("sep", "\t").option("quote", "").option("comment", "#").option("mode", "PERMISSIVE").schema(MANIFEST).csv(path)
    rows = raw.where("url IS NOT NULL AND rel_path IS NOT NULL").withColumn("line", F.monotonically_increasing_id())
    last = rows.groupBy("rel_path").agg(F.max_by(F.struct("id", "url", "title", "outlinks"), "line").alias("m"))
    return last.select("rel_path", "m.id", "m.url", F.coalesce("m.title", F.lit("")).alias("title"), F.filter(F.split(F.coalesce("m.outlinks", F.lit("")), ","), lambda x: x != "").alias("outlinks"))


def write_manifest(pages: DataFrame, path: str) -> None:
    """pages(page_id, url, title, links): a row each, tab separated."""
    rows = pages.select("page_id", page_path(F.col("page_id")), "url", sanitize_tsv(F.col("title")), F.array_join(F.transform("links", lambda x: x["url"]), ","))
    rows.write.mode("overwrite").option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


def page_path(page_id):
    return F.concat(F.lit("pages/"), zero_padded(page_id), F.lit(".html"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    line = F.btrim("value", F.lit(" \t\r\n"))
    return spark.read.text(path).select(line.alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def doc_title(manifest_title, parsed_title, path):
    """Manifest title, else the page's own, else the file's name."""
    return F.coalesce(F.nullif(manifest_title, F.lit("")), F.nullif(parsed_title, F.lit("")), F.regexp_extract(path, "([^/]*)$", 1))


def folder_corpus(spark: SparkSession, folder: str, manifest: str | None = None) -> tuple[DataFrame, DataFrame]:
    """corpus(doc_id, url, path, title, text) and links(src, url) of a folder with an optional manifest."""
    files = read_folder(spark, folder)
    page = is_html(F.col("path"))
    parsed = files.select("doc_id", "path", F.when(page, html_text(F.col("raw"))).otherwise(F.col("raw")).alias("text"), F.when(page, html_title(F.col("raw"))).otherwise("").alias("parsed"))
    if manifest is None:
        found = parsed.withColumns({"url": F.col("path"), "m_title": F.lit(""), "outlinks": F.array().cast("array<string>")})
    else:
        listed = read_manifest(spark, manifest).select("rel_path", F.col("url").alias("m_url"), F.col("title").alias("m_title"), "outlinks")
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
        relative = F.expr(f"substring(path, {len(root) + 2})")
        found = parsed.withColumn("rel_path", relative).join(listed, "rel_path", "left").withColumn("url", F.coalesce(F.nullif("m_url", F.lit("")), "path"))
    corpus = found.select("doc_id", "url", "path", doc_title(F.col("m_title"), F.col("parsed"), F.col("path")).alias("title"), "text")
    return corpus, found.select(F.col("doc_id").alias("src"), F.explode("outlinks").alias("url"))


def pages_corpus(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """corpus and links of pages(page_id, url, html)."""
    corpus = pages.select(F.col("page_id").alias("doc_id"), "url", page_path(F.col("page_id")).alias("path"), doc_title(F.lit(""), html_title(F.col("html")), F.col("url")).alias("title"), html_text(F.col("html")).alias("text"))
    links = pages.select(F.col("page_id").alias("src"), F.explode(html_links(F.col("html"), F.col("url"))).alias("l")).select("src", "l.url")
    return corpus, links


def documents_corpus(documents: DataFrame) -> DataFrame:
    """corpus of documents(doc_id, text, source): the source stands for a title, ``doc://<id>`` for a url."""
    return documents.select("doc_id", F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), F.lit("").alias("path"), F.col("source").alias("title"), "text")
