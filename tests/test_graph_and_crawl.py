from pyspark.sql import functions as F

from tidelex.operators import robots
from tidelex.operators.crawl import Crawl, CrawlOptions, function_fetcher, mirror_fetcher
from tidelex.operators.pagerank import pagerank
from tidelex.sources import corpus as S

LINKS = {"index": ["about", "search", "threads"], "about": ["index", "search"], "search": ["threads", "index"], "threads": ["index"]}
SITE = "http://site.example/"


def mirror(spark):
    rows = [(SITE + n, f"<title>{n}</title><p>{n} page" + "".join(f'<br><a href="{x}">{x}</a>' for x in to)) for n, to in LINKS.items()]
    return spark.createDataFrame(rows, "url string, html string")


def plain_ranks(n, edges, d=0.85, steps=50, tol=1e-6):
    out = [sum(s == i for s, _ in edges) for i in range(n)]
    r = [1 / n] * n
    for _ in range(steps):
        lost = sum(x for x, o in zip(r, out) if o == 0)
        new = [(1 - d) / n + d * lost / n + d * sum(r[s] / out[s] for s, t in edges if t == i) for i in range(n)]
        change, r = sum(abs(a - b) for a, b in zip(r, new)), new
        if change < tol:
            break
    return r


def test_pagerank_of_the_small_site(spark):
    edges = [(0, 1), (0, 2), (0, 3), (1, 0), (1, 2), (2, 3), (2, 0), (3, 0)]
    nodes = spark.createDataFrame([(i,) for i in range(4)], "doc_id long")
    got = {r.doc_id: r.score for r in pagerank(nodes, spark.createDataFrame(edges, "src long, dst long"), iterations=30).collect()}
    for i, want in enumerate([0.396287, 0.149781, 0.213439, 0.240493]):
        assert abs(got[i] - want) < 1e-5
    assert abs(sum(got.values()) - 1) < 1e-9


def test_pagerank_with_dangling_nodes_multi_edges_and_strangers(spark):
    edges = [(0, 1), (0, 1), (1, 1), (2, 9), (0, 3)]
    nodes = spark.createDataFrame([(i,) for i in range(4)], "doc_id long")
    got = {r.doc_id: r.score for r in pagerank(nodes, spark.createDataFrame(edges, "src long, dst long"), iterations=12, tolerance=None).collect()}
    want = plain_ranks(4, [e for e in edges if e[1] < 4], steps=12, tol=-1)
    assert all(abs(got[i] - want[i]) < 1e-12 for i in range(4))
    assert pagerank(nodes.limit(0), spark.createDataFrame([], "src long, dst long")).count() == 0


def test_pagerank_partitions_go_by_the_edges(spark, monkeypatch):
    from tidelex.operators import pagerank as P

    seen, step, key = [], P.step, "spark.sql.shuffle.partitions"
    monkeypatch.setattr(P, "step", lambda ranks, weighted, *a: seen.append((weighted.rdd.getNumPartitions(), spark.conf.get(key))) or step(ranks, weighted, *a))
    nodes, edges = spark.range(4).withColumnRenamed("id", "doc_id"), spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    asked = spark.conf.get(key)
    try:
        spark.conf.set(key, "600")
        pagerank(nodes, edges, iterations=2, tolerance=None)
        most = spark.sparkContext.defaultParallelism
        assert spark.conf.get(key) == "600" and len(seen) == 2 and all(0 < k <= most and int(c) <= most for k, c in seen)
    finally:
        spark.conf.set(key, asked)


def test_crawl_goes_breadth_first_and_restarts(spark, tmp_path):
    folder = str(tmp_path / "c")
    bodies = spark.createDataFrame([("site.example", "User-agent: *\nDisallow: /threads\n")], "host string, body string")
    first = Crawl(spark, folder, CrawlOptions(max_pages=2)).run([SITE + "index", "ftp://no"], mirror_fetcher(mirror(spark)), bodies)
    assert [(r.page_id, r.url) for r in first.where("status = 'fetched'").orderBy("page_id").collect()] == [(0, SITE + "index"), (1, SITE + "about")]
    done = Crawl(spark, folder).run([], mirror_fetcher(mirror(spark)), bodies)
    assert [(r.page_id, r.url, r.depth) for r in done.where("status = 'fetched'").orderBy("page_id").collect()] == [(0, SITE + "index", 0), (1, SITE + "about", 1), (2, SITE + "search", 1)]
    assert [r.url for r in done.where("status = 'skipped'").collect()] == [SITE + "threads"]


def test_crawl_fetches_robots_once_a_host_and_keeps_pauses(spark, tmp_path):
    """A fake site whose fetches are logged, with the time a fake clock says."""
    log = tmp_path / "log"
    log.mkdir()
    site = {SITE + n: "".join(f'<a href="{x}">{x}</a>' for x in to) for n, to in LINKS.items()} | {SITE + "robots.txt": "User-agent: *\nCrawl-delay: 0.4\nDisallow: /threads\n"}

    def get(url):
        import time
        import uuid

        (log / uuid.uuid4().hex).write_text(f"{time.time()} {url}")
        return (site[url], 200) if url in site else (None, 404)

    pages = Crawl(spark, str(tmp_path / "c"), CrawlOptions(delay=0.1)).run([SITE + "index", "http://none.example/x"], function_fetcher(get))
    assert sorted((r.url, r.status) for r in pages.collect()) == [("http://none.example/x", "failed"), *((SITE + n, "fetched") for n in ("about", "index", "search")), (SITE + "threads", "skipped")]
    asked = sorted((float(t), u) for t, u in (x.read_text().split(" ") for x in log.iterdir()))
    urls = [u for _, u in asked]
    assert len(urls) == len(set(urls)) and SITE + "threads" not in urls and {SITE + "robots.txt", "http://none.example/robots.txt"} <= set(urls)
    assert urls.index(SITE + "robots.txt") < urls.index(SITE + "index")
    times = {u: t for t, u in asked}
    assert abs(times[SITE + "about"] - times[SITE + "search"]) >= 0.39


def test_crawl_goes_on_until_the_frontier_is_empty(spark, tmp_path):
    chain = spark.createDataFrame([(f"{SITE}{k}", f'<a href="/{k + 1}">x</a>') for k in range(7)], "url string, html string")
    bodies = spark.createDataFrame([], "host string, body string")
    done = Crawl(spark, str(tmp_path / "c")).run([SITE + "0"], mirror_fetcher(chain), bodies)
    assert done.where("status = 'fetched'").count() == 7 and done.where("status = 'failed'").count() == 1
    part = Crawl(spark, str(tmp_path / "d"), CrawlOptions(max_levels=2))
    assert part.run([SITE + "0"], mirror_fetcher(chain), bodies).count() == 2 and part.run([], mirror_fetcher(chain), bodies).count() == 4


def test_levels_end_where_they_are_asked_to(spark):
    from tidelex.operators.crawl import levels

    chain, start = spark.range(5).selectExpr("id AS src", "id + 1 AS dst"), spark.range(1).selectExpr("id AS page_id")
    assert sorted(tuple(r) for r in levels(chain, start, 2).collect()) == [(0, 0), (1, 1), (2, 2)]
    assert sorted(tuple(r) for r in levels(chain, start).collect()) == [(k, k) for k in range(6)]


def test_crawl_fetches_each_capture_of_a_url(spark, tmp_path):
    captures = spark.createDataFrame([(9, SITE + "b", "<title>b"), (4, SITE + "a", "<title>a2"), (1, SITE + "a", "<title>a1")], "page_id long, url string, html string")
    bodies = spark.createDataFrame([], "host string, body string")
    seeds = captures.select("url", F.col("page_id").alias("seq"))
    got = Crawl(spark, str(tmp_path / "c"), CrawlOptions(max_pages=1, max_levels=1)).run(seeds, mirror_fetcher(captures), bodies)
    assert [(r.page_id, r.title) for r in got.collect()] == [(0, "a1")]
    assert [(r.url, r.seq < 0) for r in spark.read.parquet(str(tmp_path / "c" / "frontier" / "at=1")).orderBy("seq").collect()] == [(SITE + "a", True), (SITE + "b", True)]
    got = Crawl(spark, str(tmp_path / "d")).run(seeds, mirror_fetcher(captures), bodies)
    assert [(r.page_id, r.url, r.title) for r in got.orderBy("page_id").collect()] == [(0, SITE + "a", "a1"), (1, SITE + "a", "a2"), (2, SITE + "b", "b")]
    got = Crawl(spark, str(tmp_path / "e")).run([SITE + "a", SITE + "a"], mirror_fetcher(captures), bodies)
    assert [(r.page_id, r.title) for r in got.collect()] == [(0, "a1")]


def copies(spark, folder):
    """Pages of which two have the same url, the larger page_id first."""
    rows = [(3, "http://x/b", ""), (1, "http://x/a", ""), (0, "http://x/b", ""), (2, "http://x/c", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder


def test_a_link_leads_to_each_page_of_its_url(spark, tmp_path):
    from tidelex import catalog

    got = sorted(tuple(r) for r in catalog.resolve_outlinks(spark, copies(spark, str(tmp_path))).collect())
    assert got == [(1, 0), (1, 3), (2, 0), (2, 3), (3, 2)]  # 0 leads nowhere, 1 to page 0 and 2 to page 3


def test_pages_of_one_url_are_numbered_by_page_id(spark, tmp_path):
    from tidelex import catalog

    got = {r.page_id: r.doc_id for r in catalog.doc_id_assign(spark, copies(spark, str(tmp_path))).collect()}
    assert got == {1: 0, 0: 1, 3: 2, 2: 3}


def test_manifest_and_seeds(spark, tmp_path):
    pages = spark.createDataFrame([(3, "http://x/a", "A\tb", [("http://x/b", "t"), ("http://x/c", "")]), (4, "http://x/b", "", [])], "page_id long, url string, title string, links array<struct<url:string,anchor_text:string>>")
    S.write_manifest(pages, str(tmp_path / "m"))
    got = {r.id: (r.rel_path, r.url, r.title, r.outlinks) for r in S.read_manifest(spark, str(tmp_path / "m")).collect()}
    assert got[3] == (spark.range(1).select(S.page_path(F.lit(3))).first()[0], "http://x/a", "A b", ["http://x/b", "http://x/c"]) and got[4][1:] == ("http://x/b", "", [])
    (tmp_path / "seeds.txt").write_text("# first\n http://x/a \n\nhttp://x/b\n")
    assert [r.url for r in S.read_seeds(spark, str(tmp_path / "seeds.txt")).collect()] == ["http://x/a", "http://x/b"]


def test_command_line_crawls_and_ranks(spark, tmp_path):
    from tidelex.plans.index import SearchIndex
    from tidelex.serving.cli import main

    mirror(spark).write.parquet(str(tmp_path / "mirror.parquet"))
    (tmp_path / "seeds.txt").write_text(SITE + "index\n")
    assert main(["crawl", str(tmp_path / "seeds.txt"), str(tmp_path / "c"), "--mirror", str(tmp_path / "mirror.parquet"), "--manifest", str(tmp_path / "m"), "--delay", "0"], spark) == 0
    assert S.read_manifest(spark, str(tmp_path / "m")).count() == 4
    S.number(mirror(spark), F.col("url"), name="page_id").write.parquet(str(tmp_path / "p.parquet"))
    assert main(["build", str(tmp_path / "p.parquet"), str(tmp_path / "i")], spark) == 0
    assert main(["pagerank", str(tmp_path / "i"), "--iterations", "5", "--damping", "0.8"], spark) == 0
    assert SearchIndex.load(spark, str(tmp_path / "i")).pagerank.count() == 4


def test_index_splits_the_postings_of_one_word(spark, tmp_path):
    from tidelex.plans.index import SearchIndex

    corpus = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("u").alias("url"), F.lit("").alias("path"), F.lit("").alias("title"), F.lit("the").alias("text"))
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        SearchIndex.build(corpus).save(str(tmp_path / "i"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = spark.read.parquet(str(tmp_path / "i" / "postings")).groupBy(F.input_file_name()).count().collect()
    assert len(rows) > 1 and max(r["count"] for r in rows) < 4000


def test_edges_stay_where_they_are(spark):
    from tidelex.operators import pagerank as P

    edges = spark.range(3000).selectExpr("id % 100 AS src", "id * 7 % 100 AS dst").repartition(4, "src").persist()
    ranks = spark.range(100).selectExpr("id AS doc_id", "30L AS degree", "0.01D AS score")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = P.step(ranks, edges, 100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        edges.unpersist()
    join = plan[plan.index("SortMergeJoin [src") if "SortMergeJoin [src" in plan else 0 :]
    assert "InMemoryTableScan" in join and "hashpartitioning(src" not in plan.split("InMemoryTableScan")[0].split("SortMergeJoin")[-1]


def test_fetch_by_function(spark):
    urls = spark.createDataFrame([("http://a/1", "a", 0, 0), ("http://b/2", "b", 0, 1)], "url string, host string, depth int, seq long")
    got = {r.url: (r.ok, r.html) for r in function_fetcher(lambda u: ("body", 200) if "a" in u else ("x", 404))(urls).collect()}
    assert got == {"http://a/1": (True, "body"), "http://b/2": (False, None)}


def test_robots(spark):
    body = "Disallow: /early\nUser-agent: me\nDisallow: /a # c\nAllow: /a/b\nDisallow: /t\nAllow: /t\nCrawl-delay: 3\nCrawl-delay: x\nUser-agent: *\nDisallow: /\n"
    df = spark.createDataFrame([("h", body)], "host string, body string")
    paths = ["/a/x", "/a/b/c", "/t", "/early", "/other"]
    urls = spark.createDataFrame([("h", p) for p in paths], "host string, path string")
    got = {r.path: r.allowed for r in robots.allowed(urls, robots.rules(df, "ME")).collect()}
    assert got == {"/a/x": False, "/a/b/c": True, "/t": True, "/early": True, "/other": True}
    assert not any(r.allowed for r in robots.allowed(urls, robots.rules(df, "someone")).collect())
    assert [r.delay for r in robots.delays(df, "me").collect()] == [3.0]


def test_folder_manifest_and_numbers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, body in {"b.html": "<title>B</title>bee", "d/a.HTM": "dee", "c.txt": "<b>raw</b>", "seen.txt": "x"}.items():
        (tmp_path / name).write_text(body)
    m = tmp_path / "manifest.tsv"
    m.write_text("#id\trel\turl\ttitle\tout\n0\tb.html\thttp://x/old\tOld\t\n0\tb.html\thttp://x/b\t\thttp://x/c,\n")
    corpus, links = S.folder_corpus(spark, str(tmp_path), str(m))
    got = [(r.doc_id, r.path.rsplit("/", 1)[1], r.title, r.text) for r in corpus.orderBy("doc_id").collect()]
    assert got == [(0, "b.html", "B", "Bbee"), (1, "c.txt", "c.txt", "<b>raw</b>"), (2, "a.HTM", "a.HTM", "dee")]
    assert [(r.src, r.url) for r in links.collect()] == [(0, "http://x/c")] and corpus.where("doc_id = 0").first().url == "http://x/b"
    many = S.number(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), F.col("k"))
    assert many.where("doc_id <> k").count() == 0


def test_stream_ingest_is_once_per_url(spark, tmp_path):
    from tidelex.streaming.ingest import ingest, page_stream

    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    spark.createDataFrame([(0, "u0", "<p>alpha beta"), (1, "u1", "beta")], "page_id long, url string, html string").coalesce(1).write.parquet(src)
    ingest(page_stream(spark, src), out, ck).awaitTermination(120)
    spark.createDataFrame([(2, "u1", "again"), (3, "u2", "gamma")], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(src)
    ingest(page_stream(spark, src), out, ck).awaitTermination(120)
    assert sorted(r.doc_id for r in spark.read.parquet(f"{out}/docs").collect()) == [0, 1, 3]
    assert sorted(r.term for r in spark.read.parquet(f"{out}/postings").select("term").distinct().collect()) == ["alpha", "beta", "gamma"]


def test_serving(spark, tmp_path):
    import json
    import threading
    import urllib.error
    import urllib.request

    from tidelex.serving.cli import main
    from tidelex.serving.server import make_server
    from tidelex.plans.index import SearchIndex

    S.number(mirror(spark), F.col("url"), name="page_id").write.parquet(str(tmp_path / "p.parquet"))
    assert main(["build", str(tmp_path / "p.parquet"), str(tmp_path / "i")], spark) == 0
    assert main(["query", str(tmp_path / "i"), "about"], spark) == 0 and main(["query", str(tmp_path / "i"), "(about"], spark) == 1
    server = make_server(SearchIndex.load(spark, str(tmp_path / "i")), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{p}", timeout=60).read().decode()
    found = json.loads(get("/api/search?q=about"))
    assert found["totalMatches"] == len(found["results"]) > 0 and "<mark>" in get("/search?q=about") and "class=error" in get("/search?q=-x")
    for path, code in (("/api/search?q=-x", 400), ("/nowhere", 404), ("/search?q=" + "x" * 60_000 + "&y=" + "z" * 5_000, 400)):
        try:
            get(path)
            raise AssertionError(path)
        except urllib.error.HTTPError as e:
            assert e.code == code
    server.shutdown()
