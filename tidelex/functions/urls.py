"""URL pieces and link resolution as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelex.functions.text import lower_ascii

BASE = "(?s)^(.*?)://([^/]*)(.*)$"
# Schemes that are no page.
NO_PAGE = ("javascript:", "mailto:", "tel:", "data:")


def url_host(url: Column) -> Column:
    """Between ``://`` and the next ``/``, with the port; empty without ``://``."""
    return F.regexp_extract(url, BASE, 2)


def url_path(url: Column) -> Column:
    """From the first ``/`` after the host, query included; ``/`` if there is none."""
    path = F.regexp_extract(url, "(?s)^.*?://[^/]*(/.*)$", 1)
    return F.when(path == "", "/").otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link on page ``base``; empty for fragments, scripts, mail and the like. Dot segments stay."""
    h = F.regexp_replace(F.btrim(href, F.lit(" \t\r\n")), "(?s)#.*$", "")
    low = lower_ascii(h)
    scheme, host, path = (F.regexp_extract(base, BASE, k) for k in (1, 2, 3))
    folder = F.regexp_extract(F.when(path == "", "/").otherwise(path), "(?s)^(.*/)", 1)
    no_page = F.lit(False)
    for s in NO_PAGE:
        no_page = no_page | low.startswith(s)
    site = F.concat(scheme, F.lit("://"), host)
    return (
        F.when((h == "") | no_page, "")
        .when(low.startswith("http://") | low.startswith("https://"), h)
        .when(~base.contains("://"), "")
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(site, h))
        .otherwise(F.concat(site, folder, h))
    )


def is_http(url: Column) -> Column:
    low = lower_ascii(url)
    return low.startswith("http://") | low.startswith("https://")
