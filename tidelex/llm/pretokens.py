"""Splitting texts into pre-tokens exactly as the ``tokenizers`` library does, a piece of the text at a time.

Patterns are run by the ``regex`` module. It knows other Unicode tables than the library, so letters and numbers of which the two
may judge differently (those that Python's own tables don't have) are put to the library itself, once a process. A text
with such characters is split in a copy where they are replaced by a code point that is neither.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import regex

PIECE = 1 << 16
_NEITHER = 0x10FFFF
_RUN_OF_BLANKS = regex.compile(r"(?<=\S)\s")


@cache
def judged_otherwise() -> frozenset[str]:
    """Characters that are letters or numbers to ``regex`` and not to the library."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out: set[str] = set()
    for kind in "LN":
        doubtful = "".join(c for c in regex.findall(rf"\p{{{kind}}}", every) if unicodedata.category(c)[0] != kind)
        out |= set("".join(x for x, _ in Split(Regex(rf"\p{{{kind}}}"), "removed").pre_tokenize_str(doubtful)))
    return frozenset(out)


@cache
def newer() -> frozenset[str]:
    """Characters that ``regex`` knows and Python's own tables don't: their case and composition are the library's to say."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return frozenset(c for c in regex.findall(r"\P{Cn}", every) if unicodedata.category(c) == "Cn")


def has_any(characters: frozenset[str]) -> Callable[[str], bool]:
    """Whether a text has one of these; texts of smaller code points only are passed over quickly."""
    beyond = re.compile(f"[{min(characters, default=chr(_NEITHER))}-{chr(_NEITHER)}]").search
    return lambda text: not text.isascii() and beyond(text) is not None and not characters.isdisjoint(text)


_ASCII = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}


@cache
def basic_plane() -> dict[str, str]:
    """Letters, numbers and blanks below U+10000 as the library judges them, each as the inside of a set."""
    every, other = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)])), judged_otherwise()
    return {kind: _set([ord(c) for c in regex.findall(kind, every) if c not in other]) for kind in (r"\p{L}", r"\p{N}", r"\s")}


def _set(points: list[int]) -> str:
    """Ascending code points as ranges."""
    starts = [p for p, before in zip(points, [None, *points]) if before is None or p != before + 1]
    ends = [p for p, after in zip(points, [*points[1:], None]) if after is None or p != after - 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))


def named_form(pattern: str, kinds: dict[str, str]) -> str:
    """The pattern with these kinds of characters, and those that are no blanks, named one by one, as ``re`` takes it."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        kind = next((k for k in kinds if pattern.startswith(k, at)), None)
        if kind:
            out.append(kinds[kind] if inside else f"[{kinds[kind]}]")
            at += len(kind)
            continue
        if r"\s" in kinds and not inside and pattern.startswith(r"\S", at):
            out.append(f"[^{kinds[r'\s']}]")
            at += 2
            continue
        size = 2 if pattern[at] == "\\" else 1
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        out.append(pattern[at : at + size])
        at += size
    return "".join(out)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern in a text, as the library finds them. ``re`` is twice as fast as ``regex`` and finds them where all
    that the pattern has of kinds can be named: in texts of ASCII, and of code points below U+10000 if its kinds are those of ``basic_plane``."""
    compiled = regex.compile(pattern)
    find, other = compiled.findall, judged_otherwise()
    table = {ord(c): _NEITHER for c in other}
    has_other, find_ascii = has_any(other), re.compile(named_form(pattern, _ASCII), re.ASCII).findall
    named = named_form(pattern, basic_plane())
    find_basic = None if re.search(r"\\[^u]|\(\?[^:!=<]", named) else re.compile(named).findall
    beyond = re.compile("[\U00010000-\U0010ffff]").search

    def split(text: str) -> list[str]:
        if text.isascii():
            return find_ascii(text)
        if find_basic and beyond(text) is None:
            return find_basic(text)
        if not has_other(text):
            return find(text)
        return [text[m.start() : m.end()] for m in compiled.finditer(text.translate(table))]

    return split


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of ``size`` characters and what follows up to the next run of blanks, which no pre-token crosses into."""
    lo = 0
    while len(text) - lo > size:
        cut = _RUN_OF_BLANKS.search(text, lo + size)
        if cut is None:
            break
        yield text[lo : cut.start()]
        lo = cut.start()
    yield text[lo:] if lo else text


def around(text: str, special: dict[str, int]) -> Iterator[tuple[str, int | None]]:
    """(text before, id of the added token that follows it or None) as the library cuts added tokens out first."""
    if special and any(name in text for name in special):
        *parts, last = re.split("(" + "|".join(map(re.escape, special)) + ")", text)
        yield from zip(parts[::2], (special[x] for x in parts[1::2]))
        text = last
    yield text, None


class Memory(dict):
    """What short words were encoded to, of bounded size: when it is full, words not met since it was full before are forgotten."""

    def __init__(self, encode: Callable[[str], bytes], most: int = 250_000, short: int = 48):
        self.encode, self.most, self.short, self.before = encode, most, short, {}

    def __missing__(self, word: str) -> bytes:
        made = self.before.get(word) or self.encode(word)
        if len(word) <= self.short:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[word] = made
        return made
