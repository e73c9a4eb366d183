import pytest
from pyspark.sql import functions as F

from tidelex.functions import html as H
from tidelex.functions.urls import resolve_url, url_host, url_path

PAGE = """<html><head><title>Harbour notes</title><style>.tide{margin:0}</style></head><body><h1>Low water</h1><script>if (a < b) document.write("<i>hidden</i>");</script>
<p>Boats <em>wait</em> outside</p><a href='/quay/north'>north quay</a>, <a class=far href="http://pilots.example/rota?day=2">pilot <b>rota</b></a><a href="#foot">down</a></body></html>"""


def one(spark, html, base="https://harbour.example/log/today.html"):
    df = spark.createDataFrame([(html, base)], "html string, url string")
    r = df.select(H.html_text(F.col("html")), H.html_title(F.col("html")), H.html_links(F.col("html"), F.col("url"))).first()
    return r[0], r[1], [(x.url, x.anchor_text) for x in r[2]]


def test_page(spark):
    text, title, links = one(spark, PAGE)
    assert title == "Harbour notes" and "margin" not in text and "hidden" not in text and "Boats" in text
    assert links == [("https://harbour.example/quay/north", "north quay"), ("http://pilots.example/rota?day=2", "pilot  rota ")]


@pytest.mark.parametrize(
    "html,text,title",
    [
        ("a<>b", "ab", ""),
        ("a <b", "a ", ""),
        ("x<br>y<!-- c > d", "x y  d", ""),
        ("<title>T &amp; U</title>v", "T & Uv", "T & U"),
        ("<TITLE> a </TITLE><title>b</title>", " a b", "a b"),
        ("<script>never closed", "", ""),
        ("</script>gone</script>back", "back", ""),
        ("<scripted>shown", " shown", ""),
        ("p&amp;lt;q", "p&lt;q", ""),
        ("", "", ""),
        (None, "", ""),
    ],
)
def test_text_and_title(spark, html, text, title):
    assert one(spark, html)[:2] == (text, title)


def test_links_need_both_ends(spark):
    assert one(spark, '<a href="x">one<a href="y">two</a><a href="z">three')[2] == [("https://harbour.example/log/y", "two")]


@pytest.mark.parametrize(
    "href,result",
    [
        ("fog", "https://isle.example/chart/fog"), ("/key", "https://isle.example/key"), ("http://mainland.example/ferry", "http://mainland.example/ferry"), ("#legend", ""), ("javascript:print()", ""),
        ("fog#dense", "https://isle.example/chart/fog"), ("http://mainland.example/ferry#fares", "http://mainland.example/ferry"), ("//h/p", "https://h/p"), ("MAILTO:x", ""), (" q ", "https://isle.example/chart/q"),
    ],
)
def test_resolve(spark, href, result):
    df = spark.createDataFrame([("https://isle.example/chart/tides", href)], "b string, h string")
    assert df.select(resolve_url(F.col("b"), F.col("h"))).first()[0] == result


def test_url_parts(spark):
    df = spark.createDataFrame([("http://h:8080/p?q=1",), ("https://h",), ("nothing",)], "u string")
    assert [tuple(r) for r in df.select(url_host(F.col("u")), url_path(F.col("u"))).collect()] == [("h:8080", "/p?q=1"), ("h", "/"), ("", "/")]
