"""Search results as text, HTML and JSON. All of it is for the few best hits, which are on the driver."""

from __future__ import annotations

import html
import json
from dataclasses import dataclass

from pyspark.sql import functions as F

from tidelex.functions.text import highlight
from tidelex.operators.snippet import snippets
from tidelex.plans.index import SearchIndex
from tidelex.plans.query import QueryParseError


@dataclass
class Hit:
    doc_id: int
    title: str
    url: str
    score: float
    snippet: str = ""
    marked: str = ""


def find(index: SearchIndex, text: str, k: int = 10, with_snippets: bool = True) -> tuple[int, list[Hit]]:
    """Number of matches, and the k best. Raises QueryParseError."""
    query = index.parse(text)
    total = index.matches(query).count()
    hits = [Hit(r.doc_id, r.title or "", r.url or "", r.score) for r in index.search(query, k).collect()]
    if with_snippets and hits:
        docs = index.docs.where(F.col("doc_id").isin([h.doc_id for h in hits])).select("doc_id", "text")
        found = snippets(docs, query.terms)
        rows = {r.doc_id: r for r in found.select("doc_id", "snippet", highlight(F.col("snippet"), query.terms).alias("marked")).collect()}
        for h in hits:
            h.snippet, h.marked = rows[h.doc_id].snippet, rows[h.doc_id].marked
    return total, hits


def as_text(total: int, hits: list[Hit]) -> str:
    lines = [f"{total} matches"]
    for k, h in enumerate(hits, 1):
        lines += [f"{k}. {h.title} ({h.score:.6f})", f"   {h.url}", f"   {h.snippet}"]
    return "\n".join(lines)


def as_json(index: SearchIndex, text: str, k: int = 20) -> tuple[int, str]:
    """HTTP status and body."""
    try:
        total, hits = find(index, text, k, with_snippets=False)
    except QueryParseError as e:
        return 400, json.dumps({"error": str(e)})
    return 200, json.dumps({"totalMatches": total, "results": [{"title": h.title, "url": h.url, "score": h.score} for h in hits]}, ensure_ascii=False)


def as_html(index: SearchIndex, text: str, k: int = 20) -> str:
    body = ""
    if text.strip():
        try:
            total, hits = find(index, text, k)
            body = f"<p>{total} matches</p><ol>" + "".join(f'<li><a href="{html.escape(h.url)}">{html.escape(h.title)}</a> <small>{h.score:.6f}</small><p>{h.marked}</p></li>' for h in hits) + "</ol>"
        except QueryParseError as e:
            body = f"<p class=error>{html.escape(str(e))}</p>"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Search</title></head><body><form action="/search"><input name="q" value="{html.escape(text)}"><button>Search</button></form>{body}</body></html>'
