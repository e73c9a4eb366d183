"""Language ID by cross-parsing: the language whose text explains a document in fewest phrases.

For each language a suffix automaton is built over a bounded sample of labelled text. A document is
cut greedily into longest matches with the automaton (the cross-parsing of Ziv and Merhav);
phrases * log2(length of the language's text) / symbols is its cost, and the cheapest language wins.
Texts are read as lower-case letters with single blanks between words, one blank at either end, in
segments of 256 symbols that are parsed side by side; a phrase ends where its segment ends. Every letter of the
training text is a symbol: moves by the ``DENSE`` most frequent ones are in a dense table, all others in a sorted list.

The model is fitted on documents in the order of a hash of doc_id, each whole, until ``sample_symbols`` symbols a language
(the last one is cut there): from at most about three times ``sample_documents`` documents a language, and for the ``languages``
with the most rows. These three parameters bound the sample. Prediction reads every text whole.

Edge cases: null text or text without a letter gives ``und`` and score 0; equal costs go to the
language with more training rows, then to the smaller name; no training rows at all give ``und``.
A null doc_id is never held out and never trained on.
"""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelex.llm import textkit as K
from tidelex.llm.shared import small_batches

SAMPLE_SYMBOLS = 24_000
SAMPLE_DOCUMENTS = 48
LANGUAGES = 1000
DENSE = 60
SEGMENT = 256
SLICE = 1 << 20
UNKNOWN = "und"
#: Times the cost of its own text that a text of a language may have at most (``most_costs``).
HEADROOM = 1.3


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def letters_only(text: str) -> str:
    """Lower-case letters, one blank for any other run."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def letter_of(c: str) -> str:
    """The letter that stands for c, as in the symbol table."""
    return unicodedata.normalize("NFC", c.lower())[:1]


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the start."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p, last = last, new
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p < 0:
            continue
        q = moves[p][c]
        if length[q] == length[p] + 1:
            link[new] = q
            continue
        twin = len(moves)
        moves.append(dict(moves[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and moves[p].get(c) == q:
            moves[p][c] = twin
            p = link[p]
        link[q] = link[new] = twin
    return moves


class CrossParser:
    """All languages' automata in one transition table, walked for many segments at once."""

    def __init__(self, texts: list[tuple[str, str]]):
        """texts: (language, training text), the preferred one of equals first."""
        self.languages = [name for name, _ in texts]
        seen: dict[str, int] = {}
        for _, text in texts:
            for c in text:
                seen[c] = seen.get(c, 0) + 1
        seen.pop(" ", None)
        merged: dict[str, int] = {}
        for c, n in seen.items():
            merged[letter_of(c)] = merged.get(letter_of(c), 0) + n
        ranked = sorted(merged, key=lambda c: (-merged[c], c))
        alphabet, others = sorted(ranked[:DENSE]), sorted(ranked[DENSE:])
        code = {c: i + 2 for i, c in enumerate(alphabet)} | {" ": 1}
        self.other = len(alphabet) + 2  # letters that no automaton has
        self.width = self.other + 1  # symbol 0 fills up segments
        code |= {c: self.width + i for i, c in enumerate(others)}  # letters beyond the dense table
        self.beyond = len(others)
        code_of = {c: code[letter_of(c)] for c in seen} | {" ": 1}
        self.log_size = np.array([math.log2(max(2, len(t))) for _, t in texts])
        rows, bases, base = [], [], 0
        keys, moved = [], []
        self.restart = np.zeros((len(texts), self.beyond), np.int64)
        for k, (_, text) in enumerate(texts):
            moves = automaton([code_of[c] for c in f" {text} "])
            table = np.full((len(moves), self.width), -1, np.int64)
            self.restart[k] = base * self.width * 4 + 2
            for s, m in enumerate(moves):
                for c, t in m.items():
                    to = (base + t) * self.width * 4
                    if c < self.width:
                        table[s, c] = to
                        continue
                    keys.append((base + s) * self.beyond + c - self.width)
                    moved.append(to)
                    if s == 0:
                        self.restart[k, c - self.width] = to + 1
            table[:, self.other] = -1
            # A move is 4 times the next state's row, plus the phrases it ends. A symbol that doesn't fit ends the
            # phrase and begins the next one; one that the language has nowhere is a phrase itself.
            known = table[0] >= 0
            restart = np.where(known, table[0] + 1, base * self.width * 4 + 2)
            table = np.where(table >= 0, table, restart)
            table[0, ~known] = base * self.width * 4 + 1
            table[:, 0] = np.arange(base, base + len(moves)) * self.width * 4
            rows.append(table.astype(np.int32 if (base + len(moves)) * self.width * 4 < 1 << 31 else np.int64))
            bases.append(base * self.width)
            base += len(moves)
        self.table = np.concatenate([r.ravel() for r in rows]) if rows else np.zeros(0, np.int32)
        self.starts = np.array(bases, np.int64)
        self.keys, self.moved = np.array(keys, np.int64), np.array(moved, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.moved = self.keys[order], self.moved[order]
        self.symbol = np.zeros(0x110000, np.min_scalar_type(self.width + self.beyond))
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                self.symbol[c] = code.get(letter_of(ch), self.other)
        self.symbol[self.symbol == 0] = 1
        self.letter = self.symbol > 1

    def _beyond(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Moves by letters beyond the dense table, of each language's states."""
        if not len(self.keys):
            return np.zeros(state.shape, np.int64)
        letters = symbols.astype(np.int64) - self.width
        wanted = state // self.width * self.beyond + letters
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        starts = self.starts[:, None]
        # At the start a letter that the language lacks ends no phrase before it.
        restart = self.restart[:, letters] - ((state == starts) & (self.restart[:, letters] == starts * 4 + 2))
        return np.where(self.keys[place] == wanted, self.moved[place], restart)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by language and text, symbols and letters by text."""
        n = len(texts)
        sizes = np.array([len(t) for t in texts], np.int64) + 2
        points = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32) if n else np.zeros(0, np.uint32)
        symbols, ends = self.symbol[points], np.cumsum(sizes)
        begins = ends - sizes
        blank = symbols == 1
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        keep[begins] = True
        run = np.r_[0, np.cumsum(keep)]
        letters = np.r_[0, np.cumsum(symbols > 1)]
        letters = letters[ends] - letters[begins]
        symbols, begins, ends = symbols[keep], run[begins], run[ends]
        sizes = ends - begins
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(n), pieces)
        at = np.repeat(begins, pieces) + K.ranges(pieces) * SEGMENT
        length = np.minimum(SEGMENT, np.repeat(ends, pieces) - at)
        order = np.argsort(-length, kind="stable")
        owner, at, length = owner[order], at[order], length[order]
        count = np.zeros((len(self.languages), len(at)), np.int32)
        state = np.repeat(self.starts[:, None], len(at), 1)
        padded = np.r_[symbols, np.zeros(SEGMENT, np.uint8)]
        beyond = bool((symbols > self.other).any())
        alive = np.searchsorted(-length, -np.arange(SEGMENT), "left")  # segments longer than t
        for t in range(int(length[0]) if len(length) else 0):
            m = int(alive[t])
            now = padded[at[:m] + t]
            if beyond:
                move = self.table[state[:, :m] + np.minimum(now, self.other)]
                far = np.flatnonzero(now > self.other)
                if len(far):
                    move[:, far] = self._beyond(state[:, far], now[far])
            else:
                move = self.table[state[:, :m] + now]
            count[:, :m] += move & 3
            state[:, :m] = move >> 2
        count += state != self.starts[:, None]
        total = np.zeros((len(self.languages), n), np.int64)
        for k in range(len(self.languages)):
            total[k] = np.bincount(owner, count[k], n)
        return total, sizes, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (1 - cost / next cost) and cost a symbol of each text."""
        total, sizes, letters = self.phrases([t or "" for t in texts])
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        cost = total * self.log_size[:, None] / np.maximum(sizes, 1)
        best = np.argmin(cost, 0)
        low = cost[best, np.arange(len(texts))]
        rest = np.sort(cost, 0)[1] if len(self.languages) > 1 else low * 2
        score = np.clip(1 - low / np.maximum(rest, 1e-12), 0, 1)
        ok = letters > 0
        return [self.languages[b] if o else UNKNOWN for b, o in zip(best, ok)], np.where(ok, score, 0.0), low


def parser_of(texts: list[tuple[str, str]]) -> CrossParser:
    """Built once in each Python process: the texts are much smaller than the tables."""
    return K.model(("language", tuple(texts)), lambda: CrossParser(texts))


def fit(docs: DataFrame, sample_symbols: int = SAMPLE_SYMBOLS, sample_documents: int = SAMPLE_DOCUMENTS, languages: int = LANGUAGES) -> list[tuple[str, str]]:
    """Training text of each language, from a bounded sample of the rows that are not held out."""
    small_batches(docs.sparkSession)
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not sizes:
        return []
    place = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 3.0 * sample_documents / n)))))

    def letters(batches):
        for batch in batches:
            text = [letters_only(t)[:sample_symbols] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array(text, pa.string())], names=["lang", "place", "text"])

    rows = train.where(place < share[F.col("lang")]).select("lang", place.alias("place"), "text").mapInArrow(letters, "lang string, place double, text string")
    rows = rows.groupBy("lang", "place").agg(F.min("text").alias("text"))  # a doc_id of several texts: the smallest
    found: dict[str, str] = {}
    for r in sorted(rows.collect(), key=lambda r: (r.place, r.text)):
        if len(found.get(r.lang, "")) < sample_symbols:
            found[r.lang] = f"{found.get(r.lang, '')} {r.text}".strip()[:sample_symbols]
    return [(k, found[k]) for k in sorted(found, key=lambda k: (-sizes[k], k)) if found[k]]


def most_costs(texts: list[tuple[str, str]], least: float) -> dict[str, float]:
    """Cost a symbol up to which a text may be in each language: ``least``, or more where the language's own text costs more,
    as one half of it parsed by the other shows (scripts of thousands of letters). A text of unknown letters stays above."""
    out = {}
    for name, text in texts:
        half = len(text) // 2
        total, sizes, _ = CrossParser([(name, text[:half])]).phrases([text[half:]])
        own = float(total[0, 0]) * math.log2(max(2, half)) / int(sizes[0])
        out[name] = max(least, min(HEADROOM * own, 0.97 * math.log2(max(2, len(text)))))
    return out


def identify(docs: DataFrame, texts: list[tuple[str, str]], columns: list[str]) -> DataFrame:
    """``columns`` of docs (text among them or not) with lang_pred, score and cost."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(texts)
    fields = [docs.schema[c] for c in columns]
    source = docs.select(*columns, F.col("text").cast("string").alias("__text"))

    def run(batches):
        parser = parser_of(model.value)
        for batch in batches:
            for part in K.slices(batch, "__text", SLICE):
                lang, score, cost = parser.predict(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(cost, pa.float64())], names=[*columns, "lang_pred", "score", "cost"])
        K.release()

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return source.mapInArrow(run, StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("cost", DoubleType())]))


def language_id(docs: DataFrame, sample_symbols: int = SAMPLE_SYMBOLS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of ``docs(doc_id, text, lang)``."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    out = identify(docs, fit(docs, sample_symbols), ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
