"""HTML to text, title and links, as native Column expressions on lexed segments.

A document is cut once into segments (script and style elements, tags, text); every function classifies
segments. A tag ends at its first ``>``; an unclosed ``<`` ends the document; ``title`` and ``a`` tags leave no trace
in the text, any other tag a blank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelex.functions.urls import resolve_url

LEX = "(?is)" + "".join(f"</?{t}(?:[^a-z0-9>-][^>]*)?>(?:.*?</{t}[^>]*>|.*$)|" for t in ("script", "style")) + "<[^>]*>|<.*$|[^<]+"
SILENT = "(?is)^</?(?:script|style|a|title)[^a-z0-9-]"
UNCLOSED = "(?s)^<[^>]*$"
TITLE_TAG, ANCHOR_TAG = "(?is)^</?title[^a-z0-9-]", "(?is)^</?a[^a-z0-9-]"

# Named entities, and the ASCII that stands for them.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "-", "ndash": "-", "rsquo": "'", "lsquo": "'", "ldquo": '"', "rdquo": '"'}
ENTITY_LEX = "(?is)&(?:" + "|".join(ENTITIES) + "|#x[0-9a-f]{1,6}|#[0-9]{1,7});|[^&]+|&"


def segments(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LEX), F.lit(0))


def _shown(s: Column) -> Column:
    """What a segment adds to the text."""
    return F.when(~s.startswith("<"), s).when((s == "<>") | s.rlike(SILENT) | s.rlike(UNCLOSED), "").otherwise(" ")


def decode_entities(c: Column) -> Column:
    """One pass: nothing that comes out of an entity is decoded again."""
    names = F.create_map(*(F.lit(x) for kv in ENTITIES.items() for x in kv))

    def one(p: Column) -> Column:
        name = F.lower(F.regexp_extract(p, "(?s)^&(.*);$", 1))
        code = F.when(name.startswith("#x"), F.conv(F.substring(name, 3, 9), 16, 10)).otherwise(F.substring(name, 2, 9)).try_cast("int")
        decoded = F.when(name.startswith("#"), F.when(code.between(1, 127), F.chr(code)).otherwise(p)).otherwise(F.coalesce(F.try_element_at(names, name), p))
        return F.when(p.startswith("&") & (F.length(p) > 1), decoded).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(ENTITY_LEX), F.lit(0)), one), "")


def html_text(html: Column) -> Column:
    return decode_entities(F.array_join(F.transform(segments(html), _shown), ""))


def html_title(html: Column) -> Column:
    """All text inside title elements, decoded and trimmed."""

    def step(acc: Column, s: Column) -> Column:
        tag = s.rlike(TITLE_TAG)
        inside = F.when(tag, ~s.startswith("</")).otherwise(acc["inside"])
        more = F.when(acc["inside"] & ~s.startswith("<"), s).otherwise("")
        return F.struct(inside.alias("inside"), F.concat(acc["title"], more).alias("title"))

    start = F.struct(F.lit(False).alias("inside"), F.lit("").alias("title"))
    return F.btrim(decode_entities(F.aggregate(segments(html), start, step, lambda a: a["title"])), F.lit(" \t\r\n"))


def html_attr(tag: Column, name: str) -> Column:
    """Value of an attribute in a tag's segment: quoted, or bare up to a blank; empty if there is none."""
    pattern = f"(?is)[ \\t\\n\\f\\r]{name}=(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>][^\\s>]*)|(?:[\\s>]|$))"
    body = F.concat(F.lit(" "), F.regexp_extract(tag, "(?s)^<([^>]*)", 1))
    return F.concat(*(F.regexp_extract(body, pattern, k) for k in (1, 2, 3)))


def html_links(html: Column, base: Column) -> Column:
    """array<struct<url, anchor_text>> in document order; unclosed anchors and unresolvable links are left out."""
    link = "array<struct<url:string,anchor_text:string>>"

    def step(acc: Column, s: Column) -> Column:
        tag = s.rlike(ANCHOR_TAG)
        opens = tag & ~s.startswith("</")
        closes = tag & s.startswith("</")
        done = closes & acc["open"]
        url = resolve_url(base, acc["href"])
        made = F.array(F.struct(url.alias("url"), decode_entities(acc["text"]).alias("anchor_text")))
        return F.struct(
            F.when(tag, opens).otherwise(acc["open"]).alias("open"),
            F.when(opens, html_attr(s, "href")).otherwise(acc["href"]).alias("href"),
            F.when(opens, "").when(acc["open"] & ~tag, F.concat(acc["text"], _shown(s))).otherwise(acc["text"]).alias("text"),
            F.when(done & (url != ""), F.concat(acc["links"], made)).otherwise(acc["links"]).alias("links"),
        )

    start = F.struct(F.lit(False).alias("open"), F.lit("").alias("href"), F.lit("").alias("text"), F.array().cast(link).alias("links"))
    return F.aggregate(segments(html), start, step, lambda a: a["links"])
