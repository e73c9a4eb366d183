"""Harmonic packing: pieces of reciprocal-capacity classes, a fixed count of them in each bin.

A text's ids, then one end id, are cut into full sequences of ``capacity`` and a rest. A piece of a size in
(capacity/(k+1), capacity/k] is of class k, whose bins hold k pieces. As texts may be cut freely, a rest is cut into two or
three pieces where each cut leaves at least ``WORTH`` ids less of padding in their shares of their bins (``cut_of``); otherwise it stays whole.
Each partition fills the bins of its classes on its own. At its end the pieces of unfinished bins, fewer than k of class k,
are laid one after another and cut where a sequence is full, so that one sequence of a partition at most is left open.

``sequence_id`` is the partition's number * 2**33 + a count; ``bin_class`` is k, or 0 for sequences of the end. Edge
cases: null and empty texts are the end id alone; null doc_ids and repeated rows are packed like any other row; an empty table
has no pieces.

Ids are those of the ``tokenizers`` library: its model encodes each pre-token, and short ones are remembered, so that a word is encoded
once. Where the file's pre-tokenizer isn't the byte-level one, the library encodes each text as a whole.
"""

from __future__ import annotations

import json
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm import textkit as K
from tidelex.llm.bpe_stream import byte_symbols
from tidelex.llm.pretokens import Memory, around, pieces, splitter
from tidelex.llm.shared import small_batches

CAPACITY = 1024
END_ID = 0
WORTH = 6
PIECES = 3
WORDS = 250_000
#: What the library's byte-level pre-tokenizer splits by, which files name and don't contain: words, contractions, numbers and other
#: signs, each with a blank before it, and runs of blanks. Words stand first, as most pre-tokens are words.
PATTERN = r" ?\p{L}+|'(?:[sdmt]|ll|ve|re)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class LibraryIds:
    """Ids of a ``tokenizers`` file for whole texts, as little-endian bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        file = json.load(open(path, encoding="utf-8"))
        pre = file.get("pre_tokenizer") or {}
        added = file.get("added_tokens", [])
        by_words = not file.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.by_words = by_words and not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in added)
        if self.by_words:
            self.special = {a["content"]: a["id"] for a in added}
            self.split, self.known = splitter(PATTERN), Memory(self._word, WORDS)
            self.tokenize, self.symbols = self.library.model.tokenize, dict(enumerate(byte_symbols()))
            self.blank = self.symbols[0x20]

    def _word(self, word: str) -> bytes:
        """A pre-token's ids by the library's model, which takes byte-level symbols: of printable ASCII only the blank has another."""
        symbols = word.replace(" ", self.blank) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.symbols)
        ids = [t.id for t in self.tokenize(symbols)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> np.ndarray:
        if not self.by_words:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        out, word = [], self.known.__getitem__
        for part, token in around(text, self.special):
            for piece in pieces(part):
                out.append(b"".join(map(word, self.split(piece))))
            if token is not None:
                out.append(token.to_bytes(4, "little"))
        return np.frombuffer(b"".join(out), "<u4")


def tokenizer(path: str) -> LibraryIds:
    """Made once in each Python process."""
    return K.model(("packing", path), lambda: LibraryIds(path))


def class_of(size: int, capacity: int) -> int:
    return capacity // size


def unused(size: int, capacity: int) -> float:
    """What a piece leaves of its share of a bin."""
    return capacity / class_of(size, capacity) - size


@cache
def best_cut(rest: int, capacity: int, many: int) -> tuple[float, tuple[int, ...]]:
    """Least unused ids, and the cut, of at most ``many`` pieces of which all but one fill their shares."""
    best = (unused(rest, capacity), (rest,))
    for share in {capacity // k for k in range(2, 40)} if many > 1 else ():
        if share < rest:
            left, others = best_cut(rest - share, capacity, many - 1)
            best = min(best, (left + unused(share, capacity), (share, *others)))
    return best


@cache
def cut_of(rest: int, capacity: int) -> tuple[int, ...]:
    """The rest's pieces: each beyond the first must leave WORTH ids less unused."""
    tried = [best_cut(rest, capacity, m) for m in range(1, PIECES + 1)]
    return min(tried, key=lambda x: (x[0] + WORTH * (len(x[1]) - 1), len(x[1])))[1]


def cut(size: int, capacity: int) -> list[int]:
    """Full sequences first, then the rest's pieces."""
    rest = size % capacity
    return [capacity] * (size // capacity) + list(cut_of(rest, capacity) if rest else ())


class Bins:
    """The open bin of each class in one partition. A piece: (doc_id, start, length, ids as bytes, doc_tokens)."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next = capacity, first_id
        self.waiting: dict[int, list] = {}

    def put(self, piece: tuple) -> list[tuple]:
        """The rows of a bin that is full now: a piece, then sequence_id, offset and bin_class."""
        k = class_of(piece[2], self.capacity)
        mine = self.waiting.setdefault(k, [])
        mine.append(piece)
        return self._close(self.waiting.pop(k), k) if len(mine) == k else []

    def _close(self, held: list, k: int) -> list[tuple]:
        out, offset = [], 0
        for piece in held:
            out.append((*piece, self.next, offset, k))
            offset += piece[2]
        self.next += 1
        return out

    def finish(self) -> list[tuple]:
        out, held, room = [], [], self.capacity
        for k in sorted(self.waiting):
            for doc, start, length, ids, total in self.waiting[k]:
                while length:
                    size = min(length, room)
                    held.append((doc, start, size, ids[: 4 * size], total))
                    start, length, ids, room = start + size, length - size, ids[4 * size :], room - size
                    if not room:
                        out += self._close(held, 0)
                        held, room = [], self.capacity
        self.waiting = {}
        return out + (self._close(held, 0) if held else [])


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bin_class[, ids])."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bin_class"] + ["ids"] * with_ids

    def batch_of(rows):
        doc, start, length, ids, total, sequence, offset, k = zip(*rows)
        columns = [pa.array(c, pa.int64()) for c in (doc, start, length, [zlib.crc32(x) for x in ids], total, sequence, offset, k)]
        if with_ids:
            columns.append(pa.array([np.frombuffer(x, "<u4").tolist() for x in ids], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        encode, bins = tokenizer(path).ids, Bins(capacity, TaskContext.get().partitionId() << 33)
        rows: list = []
        for batch in batches:
            for part in K.slices(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    start = 0
                    for size in cut(len(ids), capacity):
                        rows += bins.put((doc, start, size, ids[start : start + size].tobytes(), len(ids)))
                        start += size
                    if len(rows) > 5_000:
                        yield batch_of(rows)
                        rows = []
        rows += bins.finish()
        if rows:
            yield batch_of(rows)
        K.release()

    return source.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bin_class long" + ", ids array<long>" * with_ids)
