"""PageRank over edges(src, dst): multi-edges and self links count, dangling mass is spread over all nodes.

Edges are written once and kept partitioned by src, so that an iteration moves scores and sums, which are as many as nodes, and
never the edges: a lost executor's part is read again. An iteration's table goes to the shared folder, so that lineage stays short.
A graph is small beside the pages it comes from, so the number of partitions goes by its edges: with those of the session, which
go by the pages, iterations would mostly start tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.storage import stored

DAMPING, ITERATIONS, TOLERANCE, DIGITS = 0.85, 50, 1e-6, 9
EDGES_A_TASK = 500_000


def out_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, degree) of all nodes; edges to unknown nodes don't count."""
    known = edges.join(nodes.select(F.col("doc_id").alias("dst")), "dst", "left_semi")
    return nodes.select("doc_id").join(known.groupBy(F.col("src").alias("doc_id")).agg(F.count("*").alias("degree")), "doc_id", "left").select("doc_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = edges.groupBy(F.col("dst").alias("doc_id")).agg(F.count("*").alias("degree"))
    return nodes.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def lost():
    """The scores of nodes without edges, of ranks(degree, score)."""
    return F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("score"))), F.lit(0.0))


def step(ranks: DataFrame, weighted: DataFrame, n: int, damping: float = DAMPING, dangling: float | None = None) -> DataFrame:
    """One update of ranks(doc_id, degree, score) along weighted(src, dst); the old scores stay as ``previous``. ``dangling`` is
    what ``lost`` says of the ranks, if that is known."""
    given = ranks.where("degree > 0").select(F.col("doc_id").alias("src"), (F.col("score") / F.col("degree")).alias("share"))
    received = weighted.join(given, "src").groupBy(F.col("dst").alias("doc_id")).agg(F.sum("share").alias("received"))
    given_up = ranks.agg(lost()).scalar() if dangling is None else F.lit(dangling)
    score = F.lit((1 - damping) / n) + F.lit(damping / n) * given_up + F.lit(damping) * F.coalesce("received", F.lit(0.0))
    return ranks.select("doc_id", "degree", F.col("score").alias("previous")).join(received, "doc_id", "left").select("doc_id", "degree", "previous", score.alias("score"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float | None = TOLERANCE) -> DataFrame:
    """(doc_id, score). With ``tolerance`` the loop ends at the first iteration whose total change is below it.

    Each iteration reads its scores several times, so its table is written before the next one begins:
    left lazy, the work would grow as a power of the iterations. One more read gives its change and the dangling mass.
    """
    n = nodes.count()
    if n == 0:
        return nodes.select("doc_id", F.lit(0.0).alias("score"))
    ids = nodes.select("doc_id")
    weighted = edges.join(ids.withColumnRenamed("doc_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("doc_id", "dst"), "dst", "left_semi")
    weighted = stored(weighted.select("src", "dst"), "edges")
    spark, key = nodes.sparkSession, "spark.sql.shuffle.partitions"
    asked = spark.conf.get(key)
    parts = min(int(asked), max(spark.sparkContext.defaultParallelism, (n + weighted.count()) // EDGES_A_TASK + 1))
    weighted = weighted.repartition(parts, "src").persist()
    spark.conf.set(key, parts)
    try:
        ranks = stored(out_degree(nodes, weighted).withColumn("score", F.lit(1.0 / n)), "ranks")
        dangling = ranks.agg(lost()).first()[0]
        for _ in range(iterations):
            ranks = stored(step(ranks, weighted, n, damping, dangling), "ranks")
            dangling, change = ranks.agg(lost(), F.sum(F.abs(F.col("score") - F.col("previous")))).first()
            if tolerance is not None and change < tolerance:
                break
    finally:
        spark.conf.set(key, asked)
        weighted.unpersist()
    return ranks.select("doc_id", "score")
