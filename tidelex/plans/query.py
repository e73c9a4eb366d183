"""The query language: AND, OR, NOT, phrases, parentheses. Parsed on the driver, compiled to one predicate.

    or     := and ("OR" and)*
    and    := term (["AND"] term)*
    term   := ["NOT" | "-"] primary
    primary:= WORD | "PHRASE" | "(" or ")"

Every clause needs a positive term, so each match has a row in the postings of the query's words.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelex.functions.text import STOP_WORDS, SUFFIXES, AnalyzerOptions


class QueryParseError(ValueError):
    """The query text is not in the language."""


@dataclass(frozen=True)
class Word:
    word: str


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class And:
    required: tuple
    excluded: tuple = ()


@dataclass(frozen=True)
class Or:
    choices: tuple


Node = Word | Phrase | And | Or

_TOKEN = re.compile(r'\s+|(?P<paren>[()])|"(?P<phrase>[^"]*)"?|(?P<minus>-)|(?P<word>[A-Za-z0-9](?:\'*[A-Za-z0-9])*)|.', re.DOTALL)
_IN_PHRASE = re.compile(r"[A-Za-z0-9](?:'*[A-Za-z0-9])*")


def lex(text: str) -> list[tuple[str, str]]:
    """(kind, text) with kinds ( ) NOT AND OR word phrase; other characters are skipped."""
    out = []
    for m in _TOKEN.finditer(text):
        if m["paren"]:
            out.append((m["paren"], m["paren"]))
        elif m["minus"]:
            out.append(("NOT", "-"))
        elif m["word"]:
            upper = m["word"].upper()
            out.append((upper if upper in ("AND", "OR", "NOT") else "word", m["word"]))
        elif m[0].startswith('"'):
            out.append(("phrase", m["phrase"]))
    return out


class _Parser:
    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else "end"

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def either(self) -> Node:
        found = [self.every()]
        while self.kind() == "OR":
            self.take()
            found.append(self.every())
        return found[0] if len(found) == 1 else Or(tuple(found))

    def every(self) -> Node:
        required, excluded = [], []
        first = True
        while first or self.kind() not in ("end", "OR", ")"):
            if not first and self.kind() == "AND":
                self.take()
            first = False
            negated = self.kind() == "NOT"
            if negated:
                self.take()
            (excluded if negated else required).append(self.primary())
        if not required:
            raise QueryParseError("a clause needs a term that is not negated")
        return required[0] if len(required) == 1 and not excluded else And(tuple(required), tuple(excluded))

    def primary(self) -> Node:
        kind = self.kind()
        if kind == "word":
            return Word(self.take())
        if kind == "phrase":
            words = tuple(_IN_PHRASE.findall(self.take()))
            if not words:
                raise QueryParseError("empty phrase")
            return Phrase(words)
        if kind == "(":
            self.take()
            inner = self.either()
            if self.kind() != ")":
                raise QueryParseError("a parenthesis is not closed")
            self.take()
            return inner
        raise QueryParseError(f"a word, phrase or parenthesis is missing before {kind}")


def analyze(word: str, options: AnalyzerOptions) -> str:
    """A query word as the index has it; empty if the index leaves it out."""
    w = "".join(c for c in word if c != "'").lower()
    if len(w) < options.min_length or (options.stop_words and w in STOP_WORDS):
        return ""
    if options.stem:
        for s in SUFFIXES:
            if w.endswith(s) and len(w) > len(s) + 2:
                return w[: -len(s)]
    return w


def parse(text: str) -> Node:
    if not text.strip():
        raise QueryParseError("empty query")
    parser = _Parser(lex(text))
    node = parser.either()
    if parser.kind() != "end":
        raise QueryParseError(f"unexpected {parser.kind()}")
    return node


@dataclass(frozen=True)
class ParsedQuery:
    """A query against one analyzer: its tree, all its words, and the positive ones with repetitions."""

    node: Node
    options: AnalyzerOptions = AnalyzerOptions()

    def _walk(self, node: Node, positive_only: bool):
        if isinstance(node, Word):
            yield analyze(node.word, self.options)
        elif isinstance(node, Phrase):
            yield from (analyze(w, self.options) for w in node.words)
        elif isinstance(node, Or):
            for c in node.choices:
                yield from self._walk(c, positive_only)
        else:
            for c in (*node.required, *(() if positive_only else node.excluded)):
                yield from self._walk(c, positive_only)

    @property
    def terms(self) -> list[str]:
        return list(self._walk(self.node, True))

    @property
    def counts(self) -> dict[str, int]:
        return {t: n for t, n in Counter(self.terms).items() if t}

    @property
    def words(self) -> list[str]:
        return sorted({w for w in self._walk(self.node, False) if w})

    def _phrase_words(self, node: Node) -> set[str]:
        if isinstance(node, Phrase):
            return {analyze(w, self.options) for w in node.words}
        if isinstance(node, Or):
            return set().union(*(self._phrase_words(c) for c in node.choices))
        if isinstance(node, And):
            return set().union(*(self._phrase_words(c) for c in (*node.required, *node.excluded)))
        return set()

    def _predicate(self, node: Node, flags: dict[str, Column], positions: dict[str, Column]) -> Column:
        if isinstance(node, Word):
            return flags.get(analyze(node.word, self.options), F.lit(False))
        if isinstance(node, Phrase):
            words = [analyze(w, self.options) for w in node.words]
            if any(w not in flags for w in words):
                return F.lit(False)
            if len(words) == 1:
                return flags[words[0]]

            def follows(start: Column) -> Column:
                hit = F.lit(True)
                for k, w in enumerate(words[1:], 1):
                    hit = hit & F.array_contains(positions[w], start + F.lit(k))
                return hit

            return F.coalesce(F.exists(positions[words[0]], follows), F.lit(False))
        if isinstance(node, Or):
            out = F.lit(False)
            for c in node.choices:
                out = out | self._predicate(c, flags, positions)
            return out
        out = F.lit(True)
        for c in node.required:
            out = out & self._predicate(c, flags, positions)
        for c in node.excluded:
            out = out & ~self._predicate(c, flags, positions)
        return out

    def matches(self, postings: DataFrame) -> DataFrame:
        """doc_id of all matches, with the frequency of each positive term as ``tf_<n>`` in the order of ``counts``.

        One scan of the query's words and one aggregation by document, whatever the tree looks like.
        Positions are only read for phrases.
        """
        words = self.words
        if not words:
            return postings.select("doc_id").where(F.lit(False))
        phrase = sorted(self._phrase_words(self.node) - {""})
        is_word = {w: F.col("term") == w for w in words}
        aggregates = [F.bool_or(is_word[w]).alias(f"has_{k}") for k, w in enumerate(words)]
        aggregates += [F.any_value(F.when(is_word[w], F.col("positions")), F.lit(True)).alias(f"at_{k}") for k, w in enumerate(phrase)]
        aggregates += [F.coalesce(F.max(F.when(is_word[t], F.col("tf"))), F.lit(0)).alias(f"tf_{k}") for k, t in enumerate(self.counts)]
        seen = postings.where(F.col("term").isin(words)).groupBy("doc_id").agg(*aggregates)
        flags = {w: F.col(f"has_{k}") for k, w in enumerate(words)}
        places = {w: F.col(f"at_{k}") for k, w in enumerate(phrase)}
        return seen.where(self._predicate(self.node, flags, places)).select("doc_id", *(f"tf_{k}" for k in range(len(self.counts))))


def compile_query(text: str, options: AnalyzerOptions = AnalyzerOptions()) -> ParsedQuery:
    return ParsedQuery(parse(text), options)
