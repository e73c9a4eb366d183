"""BPE as a streaming transducer with bounded lookahead, and incremental decoding.

Encoding a pre-token reads one symbol at a time. For each prefix only its last token is kept: the one
token t such that t alone, or t after the last token of what precedes it, is stable under the merge
list. A boundary is final once ``lookahead`` further symbols are read, a number computed from the
merge list, so tokens leave as soon as they are that old and memory is constant however long a pre-token is.

``lookahead``: a merge (x, u) at a boundary depends on what follows only through u: u must form, and
no earlier merge (y, .) may take u or a part y at its right edge. Following such earlier merges rank by
rank gives, for each merge, how many symbols right of its boundary can matter; the largest is the bound.
"""

from __future__ import annotations

import codecs
import json
import struct
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

from tidelex.llm.pretokens import Memory, around, has_any, newer, pieces, splitter

def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(0x100 + rest.index(b)) for b in range(256)]


BYTE_OF = {s: b for b, s in enumerate(byte_symbols())}


class MergeList:
    """A merge list with its vocabulary, and what the transducer needs of it."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix, self.vocab = suffix, vocab
        self.name = {i: t for t, i in vocab.items()}
        self.rank, self.parts, self.pair = {}, {}, {}
        for r, (a, b) in enumerate(merges):
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            self.pair.setdefault(x << 20 | y, r)
            self.rank.setdefault(t, r)
            self.parts.setdefault(t, (x, y))
        self.inner = {t: i for t, i in vocab.items() if not suffix or not t.endswith(suffix)}
        self.final = {t[: len(t) - len(suffix)]: i for t, i in vocab.items() if t.endswith(suffix)} if suffix else self.inner
        for s in byte_symbols():  # symbols alone are always there
            if s not in self.inner or s not in self.final:
                raise ValueError("not a byte-level vocabulary")
        made = set(self.parts) | {vocab[s] for s in byte_symbols()} | {self.final[s] for s in byte_symbols()}
        self.inner = {t: i for t, i in self.inner.items() if i in made}
        self.final = {t: i for t, i in self.final.items() if i in made}
        self.longest = max(len(t) for t in (*self.inner, *self.final))
        self._stable: dict[int, bool] = {}
        self._lefts: dict[int, list] = {}
        self._rights: dict[int, list] = {}
        self.lookahead = self._lookahead(merges)

    def _size(self, t: int) -> int:
        name = self.name[t]
        return len(name) - (len(self.suffix) if self.suffix and name.endswith(self.suffix) else 0)

    def _edge(self, t: int, side: int) -> list[tuple[int, float]]:
        """Parts of t at one edge, largest first, with the rank at which each is merged away."""
        out, until = [(t, float("inf"))], float("inf")
        while t in self.parts:
            until, t = self.rank[t], self.parts[t][side]
            out.append((t, until))
        return out

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens a and b next to each other stay apart: no merge across joins two edge parts before
        the one left, or not after the one right, is merged within its own token."""
        key = a << 20 | b
        found = self._stable.get(key)
        if found is not None:
            return found
        if len(self._stable) > 400_000:
            self._stable.clear()
        left = self._lefts.get(a)
        if left is None:
            left = self._lefts[a] = [(x << 20, until) for x, until in self._edge(a, 1)]
        right = self._rights.get(b)
        if right is None:
            right = self._rights[b] = self._edge(b, 0)
        rank = self.pair.get
        for x, x_until in left:
            for y, y_until in right:
                r = rank(x | y)
                if r is not None and r < x_until and r <= y_until:
                    self._stable[key] = False
                    return False
        self._stable[key] = True
        return True

    def _lookahead(self, merges) -> int:
        ranks: dict[int, list[int]] = {}  # of the merges that take a symbol from its right, by that symbol
        reach: dict[int, list[int]] = {}

        def beyond(t: int, before: float) -> int:
            most = 0
            for part, until in self._edge(t, 1):
                until = min(until, before) if until == float("inf") else until
                if part in ranks and (k := bisect_left(ranks[part], until)):
                    most = max(most, reach[part][k - 1])
            return most

        most = 1
        for r, (a, b) in enumerate(merges):
            x, u = self.vocab[a], self.vocab[b]
            need = max(self._size(u) + beyond(u, r), beyond(x, r))
            ranks.setdefault(x, []).append(r)
            reach.setdefault(x, []).append(max(need, reach[x][-1] if x in reach and reach[x] else 0))
            most = max(most, need)
        return most


class Transducer:
    """Symbols in, token ids out; ``finish`` ends the pre-token.

    ``last[i]`` is the last token of the encoding of the first i symbols held, ``start[i]`` where it begins;
    None where what precedes has left already and no held boundary fits.
    """

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.keep = 2 * merges.lookahead + merges.longest
        self._reset()

    def _reset(self):
        self.text, self.last, self.start, self.before = "", [None], [0], None

    def _read(self, table: dict[str, int], upto: int) -> None:
        text, last, start, longest = self.text, self.last, self.start, self.merges.longest
        known, stable, token, before = self.merges._stable.get, self.merges.stable, table.get, self.before
        for i in range(len(last), upto + 1):
            for j in range(i - longest if i > longest else 0, i):
                t = token(text[j:i])
                if t is None:
                    continue
                p = last[j] if j else before
                if p is None:
                    if j:
                        continue
                    ok = True
                else:
                    ok = known(p << 20 | t)
                    if ok is None:
                        ok = stable(p, t)
                if ok:
                    last.append(t)
                    start.append(j)
                    break
            else:
                last.append(None)
                start.append(0)

    def _chain(self, i: int) -> list[tuple[int, int]]:
        out = []
        while i > 0:
            out.append((i, self.last[i]))
            i = self.start[i]
        return out[::-1]

    def push(self, symbols: str) -> list[int]:
        """Ids that are final now. The last symbol waits: it may be the pre-token's end."""
        out: list[int] = []
        for at in range(0, len(symbols), self.merges.lookahead):
            self.text += symbols[at : at + self.merges.lookahead]
            self._read(self.merges.inner, len(self.text) - 1)
            if len(self.text) > self.keep:
                out += self._emit()
        return out

    def _emit(self) -> list[int]:
        n = len(self.last) - 1
        end = next(i for i in range(n, 0, -1) if self.last[i] is not None)
        done = [(i, t) for i, t in self._chain(end) if i <= n - self.merges.lookahead]
        if not done:
            return []
        cut = done[-1][0]
        # What starts before the cut can't be reached any more.
        self.before, self.text = done[-1][1], self.text[cut:]
        self.last = [None, *(t if s >= cut else None for t, s in zip(self.last[cut + 1 :], self.start[cut + 1 :]))]
        self.start = [0, *(max(0, s - cut) for s in self.start[cut + 1 :])]
        return [t for _, t in done]

    def finish(self) -> list[int]:
        if not self.text:
            return []
        self._read(self.merges.final, len(self.text))
        out = [t for _, t in self._chain(len(self.text))]
        self._reset()
        return out


class Decoder:
    """Token ids in, text out; bytes of an unfinished character wait. ``joined``: token names with blanks
    between them, as a library without a decoder prints them."""

    def __init__(self, names: dict[int, str], special: dict[int, str] | None = None, suffix: str = "", joined: bool = False):
        self.names, self.special, self.suffix, self.joined = names, special or {}, suffix, joined
        self._utf8 = None if joined else codecs.getincrementaldecoder("utf-8")("replace")
        self._any = False

    def push(self, ids) -> str:
        if self.joined:
            text = " ".join(map(self.names.__getitem__, ids))
            text, self._any = (" " if self._any and text else "") + text, self._any or bool(text)
            return text
        out = []
        for i in ids:
            name = self.names[i]
            if i in self.special:
                out += [self._utf8.decode(b"", True), name]
                continue
            end = bool(self.suffix) and name.endswith(self.suffix)
            core = name[: len(name) - len(self.suffix)] if end else name
            out.append(self._utf8.decode(bytes(BYTE_OF[c] for c in core)))
            if end:
                out.append(self._utf8.decode(b"", True) + " ")
        return "".join(out)

    def finish(self) -> str:
        return "" if self.joined else self._utf8.decode(b"", True)


class WordEncoder:
    """Normalises and splits a text as its tokenizer file says, a piece at a time, and encodes each pre-token, with a
    memory of bounded size for short ones. Beside the text itself nothing held grows with it."""

    def __init__(self, path: str):
        file = json.load(open(path, encoding="utf-8"))
        model = file["model"]
        steps = [x["type"] for x in file["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or file.get("decoder"):
            raise ValueError(f"{path}: not a word-end BPE file without a decoder")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {a["content"]: a["id"] for a in file["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.merges = MergeList(vocab, merges, model["end_of_word_suffix"])
        self.split = splitter(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.transducer = Transducer(self.merges)
        self._table = {b: s for b, s in enumerate(byte_symbols())}
        self.known = Memory(self.encode_word)
        self.names = self.merges.name | {i: t for t, i in self.special.items()}
        from tokenizers import Tokenizer

        self.has_newer, self.normalize = has_any(newer()), Tokenizer.from_file(path).normalizer.normalize_str

    def pre_tokens(self, text: str) -> list[str]:
        if self.has_newer(text):
            return self.split(self.normalize(text))
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.replace("\u03a3", "\u03c3")  # the library lowers letter by letter: no final sigma
        return self.split(text.lower())

    def encode_word(self, word: str) -> bytes:
        """Ids as little-endian bytes."""
        symbols = word.encode().decode("latin-1").translate(self._table)
        ids = self.transducer.push(symbols) + self.transducer.finish()
        return struct.pack(f"<{len(ids)}I", *ids)

    def stream(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian bytes, a piece of the text after another."""
        word = self.known.__getitem__
        for part, token in around(text, self.special):
            for piece in pieces(part):
                yield b"".join(map(word, self.pre_tokens(piece)))
            if token is not None:
                yield token.to_bytes(4, "little")

    def decoder(self) -> Decoder:
        return Decoder(self.names, joined=True)
