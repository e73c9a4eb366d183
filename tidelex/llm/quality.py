"""Quality classifier: logistic regression on hashed n-grams of words and of word shapes, trained by FTRL-proximal.

Features of a text: words and pairs of words, and one to three word shapes in a row. A shape keeps
punctuation and says where letters (a, A) and digits (0) stand, runs shortened to one; a word equal
to the one before it has a shape of its own. All are hashed into 2**18 weights, in five families,
each scaled by 1/sqrt(n) of its n-grams; a text's score is the sigmoid of one sparse dot product.

Training takes labelled rows that are not held out in the order of a hash of doc_id, at most ``sample`` of them and as many
whole texts as have ``sample_bytes`` together (the first one in any case), and goes through them in that order on the
driver; all weights together are 1 MB. Texts may be of any length, in training too.

Edge cases: null and empty texts have the score of the bias alone; labels that are null, or
rows with null doc_id, are not learned from; where a doc_id has several labels, the smallest holds, of several texts the
smallest. With nothing to learn from, every score is 0.5. A score is summed within its text alone, so equal texts get equal
scores wherever they stand.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidelex.llm import textkit as K
from tidelex.llm.shared import small_batches, stored

BITS = 18
SAMPLE = 6_000
SAMPLE_BYTES = 64 << 20
SIZES = (1, 2, 1, 2, 3)
_SALT = K.mix(np.arange(11, 11 + len(SIZES), dtype=np.uint64))
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 97


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Five arrays of feature numbers, one entry a word (the n-gram that begins there; -1 where it
    would leave the text), and the word offsets of the texts."""
    starts, ends, words = K.word_spans(data, offsets)
    h = K.word_hashes(data, starts, ends)
    shape = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | (shape[1:] == 32)
    keep[starts] = True
    run = np.r_[0, np.cumsum(keep)]
    s = K.word_hashes(shape[keep], run[starts], run[ends])
    n = len(h)
    first = np.zeros(n + 1, bool)
    first[words[:-1]] = True
    again = np.zeros(n, bool)
    again[1:] = (h[1:] == h[:-1]) & ~first[1:n]
    s = np.where(again, np.uint64(0x1234567), s)
    left = np.repeat(words[1:], np.diff(words)) - np.arange(n)  # words from here to the text's end
    shift = np.uint64(64 - BITS)
    two = lambda x: K.mix(x[:-1] * np.uint64(3) + x[1:]) if n > 1 else x[:0]
    s2 = two(s)
    s3 = K.mix(s2[:-1] * np.uint64(5) + s[2:]) if n > 2 else s[:0]
    out = []
    for k, (x, size) in enumerate(zip((h, two(h), s, s2, s3), SIZES)):
        f = np.full(n, -1, np.int64)
        f[: len(x)] = (K.mix(x ^ _SALT[k]) >> shift).astype(np.int64)
        f[left < size] = -1
        out.append(f)
    return out, words


def scores(weights: np.ndarray, bias: float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found, words = features(data, offsets)
    count = np.diff(words)
    full = np.flatnonzero(count)
    logit = np.full(len(offsets) - 1, bias)
    table = np.r_[weights, 0.0]  # -1 is the last
    for f, size in zip(found, SIZES):
        if len(full):
            logit[full] += np.add.reduceat(table[f], words[full]) / np.sqrt(np.maximum(count[full] - size + 1, 1))
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def train(rows: list[tuple[str, int]], alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.2, passes: int = 2) -> tuple[np.ndarray, float]:
    """FTRL-proximal, one text after another."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    ready = []
    for text, label in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        found, _ = features(raw, np.array([0, len(raw)], np.int64))
        at, value = [np.array([1 << BITS])], [np.ones(1)]
        for f in found:
            u, c = np.unique(f[f >= 0], return_counts=True)
            at.append(u)
            value.append(c / math.sqrt(max(1, c.sum())))
        at, value = np.concatenate(at), np.concatenate(value)
        u, back = np.unique(at, return_inverse=True)
        ready.append((u, np.bincount(back, value), label))

    def weight(at):
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    for _ in range(passes):
        for at, value, label in ready:
            w = weight(at)
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, float(w @ value)))))
            g = (p - label) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange((1 << BITS) + 1))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    place = F.xxhash64(F.lit(1), "doc_id")
    chosen = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(place, "doc_id").limit(sample)  # so its size is bounded
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    texts = stored(texts.select(place.alias("place"), "doc_id", "quality", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")), "training")
    order, total = [], 0
    for r in sorted(texts.select("place", "doc_id", "size").collect()):  # at most ``sample`` rows of three numbers
        total += r.size
        if order and total > sample_bytes:
            break
        order.append((r.place, r.doc_id))
    if not order:
        return train([])
    last, upto = order[-1]
    rows = texts.where((F.col("place") < last) | (F.col("place") == last) & (F.col("doc_id") <= upto)).collect()
    return train([(r.text, r.quality) for r in sorted(rows, key=lambda r: (r.place, r.doc_id))])


def score(docs: DataFrame, model: tuple[np.ndarray, float], columns: list[str]) -> DataFrame:
    """``columns`` of docs with the score of each whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*columns, F.col("text").cast("string").alias("__text"))

    def run(batches):
        K.model("quality", lambda: None)  # the weights are the broadcast's own
        weights, bias = shared.value
        for batch in batches:
            for part in K.slices(batch, "__text"):
                s = scores(weights, bias, *K.text_buffers(part.column("__text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(s, pa.float64())], names=[*columns, "score"])
        K.release()

    return source.mapInArrow(run, StructType([*(docs.schema[c] for c in columns), StructField("score", DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted) of ``docs(doc_id, text)`` by ``labels(doc_id, quality)``."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = score(docs, fit(docs, labels, sample, sample_bytes), ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
