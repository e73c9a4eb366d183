"""Substring dedup: every window of 50 words is hashed (Rabin-Karp) and counted in Spark.

Plan, for documents of any number:
1. each task hashes all windows of its texts, a slice of ``SLICE`` bytes at a time. A window that a smaller doc_id
   of the same slice has is repeated whatever the others hold, so it is marked at once; what leaves is the least
   doc_id's. So a window of very many documents is in a range once for each slice, not once for each document;
2. windows are packed by hash range, 7 bytes of hash and the steps from one document and position to the
   next as planes of bytes. The number of ranges follows from the bytes of all texts, ``RANGE`` to each, so that a
   range has the same size for any corpus; beyond ``2**FAN_OUT`` ranges they are split in two steps, since one slice
   would leave next to nothing for each. Each range is counted in one group: a window is repeated where a smaller doc_id has it;
3. repeated positions go back, packed by document; a bit map of fixed size says which texts have
   any, so that only those texts are shuffled, to be cut by maximal removal intervals.

Ties and edge cases: rows with null doc_id take part in nothing and keep all words; null and empty
texts have no words; a row repeated with the same doc_id is one document, so it never removes
itself. Rows of one doc_id may have different texts: a mark holds for a text whose window it is, as 32 bits of its
hash say. Hashes have 64 bits, all of which are compared: there are 256 ranges at least, so 7 bytes are left to pack.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm import textkit as K
from tidelex.llm.shared import bits_for, shuffle_partitions, small_batches, stored, text_bytes

WINDOW = 50
MAP_BITS = 26
SLICE = 2 << 20
RANGE = 8 << 20
TASK = 32 << 20
FAN_OUT = 12
PACKED = "range int, hashes binary, docs binary, counts binary, places binary, checks binary"
MARKS = "to int, docs binary, counts binary, places binary, checks binary"


def _windows(part: pa.RecordBatch, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place of every window of a slice's texts."""
    data, offsets = K.text_buffers(part.column("text"))
    starts, ends, words = K.word_spans(data, offsets)
    h, at = K.windows_of_texts(K.word_hashes(data, starts, ends), words, window)
    row = np.searchsorted(words, at, "right") - 1
    return h, row, at - words[row]


def _repeated(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller doc has the same hash."""
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(_new(h[order]))
    least = np.minimum.reduceat(doc[order], first) if len(h) else doc
    out = np.empty(len(h), bool)
    out[order] = doc[order] > np.repeat(least, np.diff(np.r_[first, len(h)]))
    return out


def _new(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def _groups(key: np.ndarray, bits: int, doc: np.ndarray, place: np.ndarray):
    """(number, its entries in the order given, where runs of one doc with ascending places begin) of each key below 2**bits."""
    order = np.argsort(key.astype(np.uint16 if bits <= 16 else np.uint32), kind="stable")
    cuts = np.r_[np.flatnonzero(_new(key[order])), len(key)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        at = order[a:b]
        new = _new(doc[at])
        new[1:] |= place[at[1:]] <= place[at[:-1]]
        yield int(key[at[0]]), at, np.flatnonzero(new)


def _steps(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences within each run; the run's first value stays."""
    out = np.diff(x, prepend=0)
    out[first] = x[first]
    return out


def _of_ranges(h: np.ndarray, doc: np.ndarray, place: np.ndarray, bits: int) -> list[tuple]:
    """Rows of PACKED, one for each hash range."""
    low = (h << np.uint64(bits)).view(np.uint8).reshape(-1, 8)[:, 1:]
    rows = []
    for k, at, first in _groups(h >> np.uint64(64 - bits), bits, doc, place):
        ids = doc[at[first]]
        rows.append((k, low[at].tobytes(), K.planes(np.diff(ids, prepend=0), np.int64), K.planes(np.diff(np.r_[first, len(at)]), np.uint32), K.planes(_steps(place[at], first), np.uint32), None))
    return rows


def _of_range(row: dict, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, doc and place of a packed row."""
    counts = K.from_planes(row["counts"], np.uint32).astype(np.int64)
    run = np.cumsum(K.from_planes(row["places"], np.uint32).astype(np.int64))
    first = np.cumsum(counts) - counts
    run -= np.repeat(np.r_[0, run[first[1:] - 1]] if len(first) else run, counts)
    full = np.zeros((len(run), 8), np.uint8)
    full[:, 1:] = np.frombuffer(row["hashes"], np.uint8).reshape(-1, 7)
    h = (full.view(np.uint64).ravel() >> np.uint64(bits)) | np.uint64(row["range"] << (64 - bits))
    return h, np.repeat(np.cumsum(K.from_planes(row["docs"], np.int64)), counts), run


def _of_marks(h: np.ndarray, doc: np.ndarray, place: np.ndarray, groups: int) -> list[tuple]:
    """Rows of MARKS, one for each group of documents."""
    rows = []
    for k, at, first in _groups(K.mix(doc.view(np.uint64)) % np.uint64(groups), groups.bit_length(), doc, place):
        rows.append((k, K.planes(doc[at[first]], np.int64), K.planes(np.diff(np.r_[first, len(at)]), np.uint32), K.planes(place[at], np.uint32), K.planes(h[at] & np.uint64(0xFFFFFFFF), np.uint32)))
    return rows


def _columns(rows: list[tuple], schema: str) -> tuple[list, list]:
    names = [x.split()[0] for x in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(names)
    return [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names


def _pack(batches, window: int, bits: int, groups: int, slice_bytes: int = SLICE):
    """Packed windows of the tasks' texts, and beside them, at negative ranges, what is known as repeated here already."""
    K.model("windows", lambda: None)
    for batch in batches:
        batch = batch.filter(batch.column("doc_id").is_valid())
        for part in K.slices(batch, "text", slice_bytes):
            h, row, place = _windows(part, window)
            doc = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[row]
            again = _repeated(h, doc)
            rows = _of_ranges(h[~again], doc[~again], place[~again], bits)
            if again.any():
                # Of a run of repeated windows each 50th and the last one cover the same words.
                at = np.flatnonzero(again)
                ends = (np.diff(at, append=-2) != 1) | (np.diff(row[at], append=-1) != 0)
                starts = np.r_[True, ends[:-1]]
                since = np.arange(len(at)) - np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
                at = at[ends | (since % window == 0)]
                rows += [(-1 - r[0], None, *r[1:]) for r in _of_marks(h[at], doc[at], place[at], groups)]
            if rows:
                yield pa.RecordBatch.from_arrays(*_columns(rows, PACKED))
    K.release()


def _split(batches, bits: int, finer: int):
    """Rows of 2**bits ranges as rows of 2**finer ranges."""

    def flush(held):
        h, doc, place = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays(*_columns(_of_ranges(h, doc, place, finer), PACKED))

    held, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["range"] < 0:
                yield pa.RecordBatch.from_arrays(*_columns([tuple(row.values())], PACKED))
                continue
            held.append(_of_range(row, bits))
            size += len(held[-1][0])
            if size > 1 << 19:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def _count(table: pa.Table, bits: int, groups: int) -> pa.Table:
    """Of one hash range: windows that a smaller doc_id has, packed by group of documents. Marks pass."""
    rows = [r for batch in table.to_batches() for r in batch.to_pylist()]
    if rows[0]["range"] < 0:
        out = [(-1 - r["range"], *(r[k] for k in ("docs", "counts", "places", "checks"))) for r in rows]
    else:
        h, doc, place = (np.concatenate(x) for x in zip(*(_of_range(r, bits) for r in rows)))
        again = _repeated(h, doc)
        out = _of_marks(h[again], doc[again], place[again], groups)
    columns, names = _columns(out, MARKS)
    K.release()
    return pa.Table.from_arrays(columns, names=names)


def _cut(text: str | None, starts: np.ndarray | None, window: int) -> tuple[int, int, str, list[bytes]]:
    """Words, removed words, digest and kept words, given the starts of repeated windows."""
    words = left = (text or "").encode().split()
    if starts is not None and len(starts):
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + window, -1)
        left = list(compress(words, np.cumsum(cover[:-1]) == 0))
    return len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest(), left


def _marked(part: pa.RecordBatch, marks: dict[int, tuple[np.ndarray, np.ndarray]], window: int) -> dict[int, np.ndarray]:
    """Starts of repeated windows by row: the marks of its doc_id that are windows of its text."""
    h, row, place = _windows(part, window)
    bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
    out = {}
    for i, doc in enumerate(part.column("doc_id").to_pylist()):
        at, check = marks.get(doc, (None, None)) if doc is not None else (None, None)
        if at is not None:
            own = h[bounds[i] : bounds[i + 1]]
            inside = at < len(own)
            at, check = at[inside], check[inside]
            out[i] = at[(own[at] & np.uint64(0xFFFFFFFF)) == check]
    return out


def _rows(part: pa.RecordBatch, marks: dict[int, tuple[np.ndarray, np.ndarray]], window: int, with_text: bool, carry: list[str]):
    starts = _marked(part, marks, window) if marks else {}
    texts = part.column("text").to_pylist()
    found = [_cut(t, starts.get(i), window) for i, t in enumerate(texts)]
    columns = [part.column("doc_id").cast(pa.int64()), *(pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))]
    if with_text:  # untouched texts stay as they are, with their own white space
        columns.append(pa.array([t if x[1] == 0 else b" ".join(x[3]).decode() for x, t in zip(found, texts)], pa.string()))
    return columns + [part.column(f"__{c}") for c in carry]


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False, map_bits: int = MAP_BITS, carry: tuple[str, ...] = (), range_bytes: int = RANGE, fan_out: int = FAN_OUT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) and the columns ``carry`` for each row of
    ``docs(doc_id, text)``. A kept text with removals has its words joined by blanks; others stay as they are.

    ``map_bits``: the bit map of documents with repeats has 2**map_bits bits (8 MB), whatever their
    number; a full map only means that more texts are shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    carry = list(carry)
    kinds = "".join(f", `__{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(F.col(c).alias(f"__{c}") for c in carry))
    size = text_bytes(docs)
    finer, tasks = bits_for(size, range_bytes, 8), max(shuffle_partitions(spark), -(-size // TASK))
    bits, groups = min(finer, fan_out), 1 << finer
    packed = docs.select("doc_id", "text").mapInArrow(lambda it: _pack(it, window, bits, groups), PACKED)
    if finer > bits:
        packed = packed.repartition(tasks, "range").sortWithinPartitions("range").mapInArrow(lambda it: _split(it, bits, finer), PACKED)
    repeats = stored(packed.repartition(tasks, "range").groupBy("range").applyInArrow(lambda t: _count(t, finer, groups), MARKS), "repeats")

    def places(it):
        for batch in it:
            ids = np.unique(np.concatenate([np.zeros(0, np.int64), *(K.from_planes(x, np.int64) for x in batch.column("docs").to_pylist())]))
            yield pa.RecordBatch.from_arrays([pa.array((K.mix(ids.view(np.uint64)) >> np.uint64(64 - map_bits)).astype(np.int64) + 1)], names=["bit"])  # Spark counts them from 1

    bit_map = np.zeros(max(4096, 1 << (map_bits - 3)), np.uint8)
    filled = repeats.select("docs").mapInArrow(places, "bit long").groupBy(F.expr("bitmap_bucket_number(bit)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    for k, b in filled.toLocalIterator():  # at most 2**map_bits / 32768 rows of 4 KB
        bit_map[(k - 1) * 4096 : k * 4096] = np.frombuffer(bytes(b), np.uint8)
    marked = spark.sparkContext.broadcast(bit_map)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text + [f"__{c}" for c in carry]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text + kinds

    def has_marks(batch):
        ids = batch.column("doc_id")
        place = K.mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(64 - map_bits)
        on = (marked.value[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
        return (on == 1) & ids.is_valid().to_numpy(zero_copy_only=False)

    def untouched(it):
        for batch in it:
            for part in K.slices(batch.filter(pa.array(~has_marks(batch))), "text"):
                yield pa.RecordBatch.from_arrays(_rows(part, {}, window, with_text, carry), names=names)

    def touched(it):
        for batch in it:
            part = batch.filter(pa.array(has_marks(batch)))
            to = (K.mix(part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(to), *part.columns], names=["to", *part.schema.names])

    def cut(texts: pa.Table, found: pa.Table) -> pa.Table:
        doc, at, check = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for batch in found.to_batches():
            for r in batch.to_pylist():
                doc.append(np.repeat(K.from_planes(r["docs"], np.int64), K.from_planes(r["counts"], np.uint32)))
                at.append(K.from_planes(r["places"], np.uint32))
                check.append(K.from_planes(r["checks"], np.uint32))
        doc, at, check = np.concatenate(doc), np.concatenate(at).astype(np.int64), np.concatenate(check)
        order = np.argsort(doc, kind="stable")
        doc, at, check = doc[order], at[order], check[order]
        first = np.flatnonzero(_new(doc))
        marks = {int(doc[a]): (at[a:b], check[a:b]) for a, b in zip(first, np.r_[first[1:], len(doc)])}
        out = [pa.RecordBatch.from_arrays(_rows(part, marks, window, with_text, carry), names=names) for batch in texts.to_batches() for part in K.slices(batch, "text")]
        plain = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text + [texts.schema.field(f"__{c}") for c in carry])
        K.release()
        return pa.Table.from_batches(out, plain)

    some = docs.mapInArrow(touched, "to int, doc_id long, text string" + kinds).repartition(tasks, "to").groupBy("to").cogroup(repeats.repartition(tasks, "to").groupBy("to")).applyInArrow(cut, schema)
    return docs.mapInArrow(untouched, schema).unionByName(some).withColumnsRenamed({f"__{c}": c for c in carry})
