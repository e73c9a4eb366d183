"""Command line: build, crawl, pagerank, query and serve."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidelex.functions.text import AnalyzerOptions
from tidelex.operators.crawl import Crawl, CrawlOptions, function_fetcher, mirror_fetcher
from tidelex.operators.pagerank import pagerank
from tidelex.plans.index import SearchIndex
from tidelex.plans.query import QueryParseError
from tidelex.serving.render import as_text, find
from tidelex.serving.server import make_server
from tidelex.sources.corpus import folder_corpus, pages_corpus, read_seeds, write_manifest


def http_get(agent: str, timeout: float = 10.0):
    """A fetch by the standard library. It has never been run against a live site here."""

    def get(url: str) -> tuple[str | None, int]:
        import urllib.error
        import urllib.request

        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
                return r.read().decode("utf-8", "replace"), r.status
        except urllib.error.HTTPError as e:
            return None, e.code
        except (OSError, ValueError):
            return None, 0

    return get


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelex")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="index a folder, or a Parquet table of pages")
    b.add_argument("source")
    b.add_argument("index")
    b.add_argument("--manifest")
    b.add_argument("--stopwords", action="store_true")
    b.add_argument("--stem", action="store_true")
    b.add_argument("--min-length", type=int, default=1)
    c = sub.add_parser("crawl", help="fetch pages breadth first")
    c.add_argument("seeds")
    c.add_argument("folder")
    c.add_argument("--mirror", help="a Parquet table of pages in place of the network")
    c.add_argument("--max-pages", type=int, default=CrawlOptions.max_pages)
    c.add_argument("--agent", default=CrawlOptions.agent)
    c.add_argument("--delay", type=float, default=CrawlOptions.delay, help="seconds between the fetches of one host")
    c.add_argument("--timeout", type=float, default=10.0, help="seconds that one fetch may take")
    c.add_argument("--outlinks", type=int, default=CrawlOptions.outlink_cap, help="links followed from one page")
    c.add_argument("--frontier", type=int, default=CrawlOptions.frontier_limit, help="new urls kept after one level")
    c.add_argument("--no-robots", action="store_true", help="fetch no robots.txt and allow all")
    c.add_argument("--manifest", help="where to write a table of the pages, tab separated")
    r = sub.add_parser("pagerank", help="score the link graph of an index")
    r.add_argument("index")
    r.add_argument("--damping", type=float, default=0.85)
    r.add_argument("--iterations", type=int, default=50)
    q = sub.add_parser("query", help="answer one query, or lines from standard input")
    q.add_argument("index")
    q.add_argument("text", nargs="?")
    q.add_argument("-k", type=int, default=10)
    s = sub.add_parser("serve", help="answer over HTTP")
    s.add_argument("index")
    s.add_argument("--port", type=int, default=8080)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("tidelex").getOrCreate()
    if a.command == "build":
        corpus, links = pages_corpus(spark.read.parquet(a.source)) if a.source.endswith(".parquet") else folder_corpus(spark, a.source, a.manifest)
        index = SearchIndex.build(corpus, AnalyzerOptions(a.stopwords, a.stem, a.min_length), links).save(a.index)
        print(f"{index.size()} documents, {index.lexicon.count()} terms")
    elif a.command == "crawl":
        fetch = mirror_fetcher(spark.read.parquet(a.mirror)) if a.mirror else function_fetcher(http_get(a.agent, a.timeout))
        seeds = [r.url for r in read_seeds(spark, a.seeds).collect()]
        options = CrawlOptions(a.max_pages, a.outlinks, a.frontier, a.delay, a.agent)
        pages = Crawl(spark, a.folder, options).run(seeds, fetch, spark.createDataFrame([], "host string, body string") if a.no_robots else None)
        if a.manifest:
            write_manifest(pages.where("status = 'fetched'"), a.manifest)
        print({r["status"]: r["count"] for r in pages.groupBy("status").count().collect()})
    elif a.command == "pagerank":
        index = SearchIndex.load(spark, a.index)
        index.save_pagerank(pagerank(index.docs, index.edges, a.damping, a.iterations), a.index)
    elif a.command == "query":
        index = SearchIndex.load(spark, a.index)
        for text in [a.text] if a.text is not None else (line.rstrip("\n") for line in sys.stdin):
            try:
                print(as_text(*find(index, text, a.k)))
            except QueryParseError as e:
                print(f"error: {e}")
                if a.text is not None:
                    return 1
    else:
        with make_server(SearchIndex.load(spark, a.index), a.port) as server:
            server.serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
