"""What several operators share: sizes, connected components, and the shared folder of tidelex.storage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.storage import collect_shuffles, new_path, scratch, stored

__all__ = ["bits_for", "collect_shuffles", "components", "new_path", "scratch", "shuffle_partitions", "small_batches", "stored", "text_bytes"]

IN_TASK = 300_000
BATCH_BYTES = 8 << 20
_BATCHES, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES (one row at least) in this session, unless it has a bound of its own. Spark's, of 64 MB, is
    held several times over on either side of each task; rows count 10,000 at most as before."""
    if spark.conf.get(_BATCHES, None) == _SPARKS_OWN:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one pass over that column."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bits_for(amount: int, each: int, least: int = 4) -> int:
    """Bits of the smallest power of two of buckets that leaves at most ``each`` bytes of ``amount`` to one."""
    return max(least, (-(-amount // each) - 1).bit_length() if amount else 0)


def _contract(batches):
    """Edges of one task as stars: each node beside the smallest node it reaches here."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = sorted(x for x in root if find(x) != x)
    for lo in range(0, len(nodes), 100_000):
        part = nodes[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, most: int = 60, in_task: int = IN_TASK) -> DataFrame:
    """(node, component) for the nodes of ``edges(a, b)``; component is the smallest node.

    Edges are dealt out evenly, ``in_task`` to a task, and each task contracts its own to stars; where one
    task had all of them, these are the components. Otherwise large-star and small-star contractions
    alternate: each round is two aggregations by node (combined before the shuffle) and two joins, and rounds end
    when the edges no longer change. The tables between rounds go to the shared folder.
    """
    edges = stored(edges.where("a <> b").select("a", "b"), "edges")
    tasks = -(-edges.count() // in_task)
    now = stored(edges.repartition(max(1, tasks)).mapInArrow(_contract, "a long, b long"), "edges")
    seen = None
    for _ in range(most if tasks > 1 else 0):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = stored(small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        if tasks > 1:
            raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
