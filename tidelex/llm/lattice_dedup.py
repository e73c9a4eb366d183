"""Embedding near-dedup by lattice hashing: random projections decoded to points of E8, in several tables.

A table projects a unit vector to 8*BLOCKS dimensions, scales it and decodes each block of 8 to its nearest
point of the lattice E8; the points together are its cell. Each vector is stored in its own cell and
looked up in its own and in PROBES neighbouring cells: those where one block goes to one of its next
nearest points, nearest to a boundary first. Pairs of vectors of one label that meet anywhere are verified by
cosine in double precision; a pair is a link from 0.93 on.

Equal vectors are one class before anything is paired, so copies never meet as pairs. Cells are joined in
blocks of at most BLOCK stored vectors; a hot cell has several blocks and each looked-up vector meets all
of them. Classes with a pair are linked by their smallest vec_id. No pair is dropped or capped.

Edge cases: vectors that are null, empty, zero or have a null or non-finite component, and rows with null
label, link with nothing; vectors of different lengths have no cosine and don't link. Equal links need both
labels equal. Rows with null vec_id are returned, unlinked. A repeated vec_id is two vectors of one number.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm import textkit as K
from tidelex.llm.shared import components, stored

COSINE = 0.93
TABLES, BLOCKS, PROBES, SCALE = 12, 2, 8, 0.6
BLOCK = 512


def decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8 (integers with an even sum): round, and where the sum is odd round the worst
    coordinate the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(-1) % 2 != 0)
    if len(odd):
        d = x[odd] - r[odd]
        k = np.argmax(np.abs(d), -1)
        rows = np.arange(len(odd))
        step = np.where(d[rows, k] >= 0, 1.0, -1.0)
        r[odd, k] += step
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 = D8 and D8 + 1/2, for rows of 8, doubled so that they are integers."""
    a, b = decode_d8(x), decode_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1)
    return (2 * np.where(nearer[..., None], a, b)).astype(np.int64)


def roots() -> np.ndarray:
    """The 240 shortest points of E8, doubled: the directions of neighbouring cells."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s in (2, -2):
            for t in (2, -2):
                v = [0] * 8
                v[i], v[j] = s, t
                out.append(v)
    out += [v for v in itertools.product((1, -1), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out, np.int64)


_ROOTS = roots()
_COEFF = K.mix(np.arange(101, 109, dtype=np.uint64)) | np.uint64(1)


def projection(dim: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    """A table's Gaussian directions, and its offset of the lattice."""
    random = np.random.default_rng([20_240, dim, table])
    return random.standard_normal((dim, 8 * BLOCKS)), random.uniform(0, 1, 8 * BLOCKS)


def cells(unit: np.ndarray, label: np.ndarray, table: int, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """Cell numbers of each vector in a table: its own first, then the neighbours to look up."""
    directions, offset = projection(unit.shape[1], table)
    y = (unit @ directions * scale + offset).reshape(len(unit), BLOCKS, 8)
    points = decode_e8(y.reshape(-1, 8)).reshape(len(unit), BLOCKS, 8)
    rest = y - points / 2
    # How far beyond the boundary towards each neighbour: |r|^2/2 - <d, r>, least first.
    cost = (_ROOTS**2).sum(1)[None, None] / 8 - rest @ (_ROOTS.T / 2)
    own = (points.view(np.uint64) * _COEFF).sum(-1, dtype=np.uint64)
    salt = K.mix(label.astype(np.int64).view(np.uint64) * np.uint64(1_000_003) + np.uint64(table * 2 + 1))
    weight = K.mix(np.arange(7, 7 + BLOCKS, dtype=np.uint64)) | np.uint64(1)
    whole = (K.mix(own) * weight).sum(1, dtype=np.uint64)
    flat = cost.reshape(len(unit), -1)
    near = np.argpartition(flat, probes, 1)[:, :probes]
    block, root = near // len(_ROOTS), near % len(_ROOTS)
    rows = np.arange(len(unit))[:, None]
    moved = own[rows, block] + (_ROOTS.view(np.uint64) * _COEFF).sum(1, dtype=np.uint64)[root]
    other = whole[:, None] - K.mix(own[rows, block]) * weight[block] + K.mix(moved) * weight[block]
    return K.mix(np.c_[whole, other] ^ salt[:, None])


def _usable(column: pa.Array) -> np.ndarray:
    """Vectors that are there, with finite components that are not all zero."""
    values = column.flatten()
    length = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    x = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(length)
    bad, some = np.r_[0, np.cumsum(~np.isfinite(x))], np.r_[0, np.cumsum(x != 0)]
    return (length > 0) & (bad[ends] == bad[ends - length]) & (some[ends] > some[ends - length])


def _matrices(column: pa.Array, most: int = 512):
    """(rows, their vectors as doubles scaled to length 1) of usable vectors, some of one length at a time."""
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    for dim in np.unique(length).tolist():
        at = np.flatnonzero(length == dim)
        for rows in np.array_split(at, -(-len(at) // most)):
            x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            x /= np.abs(x).max(1, keepdims=True)
            yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def lattice_links(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES) -> tuple[DataFrame, DataFrame]:
    """(classes, links): classes(cid, label, embedding, size) of equal vectors, links(a, b) between classes."""

    def usable(batches):
        for batch in batches:
            yield batch.filter(pa.array(_usable(batch.column("embedding"))))

    good = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL").mapInArrow(usable, vectors.schema)
    classes = stored(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("size"), F.max("vec_id").alias("high")).withColumn("cid", F.xxhash64("label", "embedding")), "vectors")

    def look(batches):
        for batch in batches:
            label, cid = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("cid").to_numpy()
            for rows, x in _matrices(batch.column("embedding")):
                for table in range(tables):
                    c = cells(x, label[rows], table).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cid[rows], c.shape[1])), pa.array(c.ravel()), pa.array(np.tile(np.arange(c.shape[1]) == 0, len(rows)))], names=["cid", "cell", "own"])

    seen = classes.mapInArrow(look, "cid long, cell long, own boolean")
    seen = stored(seen, "cells")
    # Cells that only one class meets say nothing; big ones are stored in blocks.
    load = seen.groupBy("cell").agg(F.sum(F.col("own").cast("int")).alias("kept"), F.count("*").alias("met")).where("kept > 0 AND met > 1")
    load = load.select("cell", F.ceil(F.col("kept") / BLOCK).cast("int").alias("blocks"))
    dealt = seen.join(load, "cell")
    kept = dealt.where("own").select("cell", F.expr(f"pmod(xxhash64(cid), blocks)").cast("int").alias("block"), "cid")
    asked = dealt.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "cid")
    pairs = asked.withColumnRenamed("cid", "x").join(kept.withColumnRenamed("cid", "y"), ["cell", "block"]).where("x <> y")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    unit = classes.select("cid", "embedding")
    both = pairs.join(unit.select(F.col("cid").alias("a"), F.col("embedding").alias("u")), "a").join(unit.select(F.col("cid").alias("b"), F.col("embedding").alias("v")), "b")

    def verify(batches):
        for batch in batches:
            u, v = batch.column("u"), batch.column("v")
            lu, lv = np.diff(u.offsets.to_numpy()), np.diff(v.offsets.to_numpy())
            ok = np.zeros(batch.num_rows, bool)
            for dim in set(lu[lu == lv].tolist()):
                rows = np.flatnonzero((lu == dim) & (lv == dim))
                x, y = (np.array(c.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim) for c in (u, v))
                x, y = (z / np.abs(z).max(1, keepdims=True) for z in (x, y))
                ok[rows] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)) >= cosine
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])

    return classes, stored(both.mapInArrow(verify, "a long, b long"), "links")


def embedding_components(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of ``vectors(vec_id, embedding, label)``."""
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long"))
    classes, links = lattice_links(vectors, cosine, tables)
    size = classes.select("cid", "size", "low")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(size.select(F.col("cid").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("others"))
    low = size.select("cid", "low")
    edges = links.join(low.withColumnsRenamed({"cid": "a", "low": "la"}), "a").join(low.withColumnsRenamed({"cid": "b", "low": "lb"}), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    found = components(edges)
    of = size.join(degree, size.cid == degree.a, "left").join(found, size.low == found.node, "left")
    of = of.select("cid", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "low").alias("component"))
    keyed = vectors.withColumn("cid", F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.xxhash64("label", "embedding")))
    out = keyed.select("vec_id", "cid").join(of, "cid", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
