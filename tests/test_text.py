import random
import re

from pyspark.sql import functions as F

from tidelex.functions import text as T
from tidelex.functions.text import AnalyzerOptions, tokenize
from tidelex.operators.snippet import best_windows, snippets, token_spans
from tidelex.plans.query import analyze


def model_tokens(s: str) -> list[str]:
    out, word = [], ""
    for c in s:
        if re.fullmatch("[A-Za-z0-9]", c):
            word += c
        elif c == "'" and word:
            continue
        else:
            out += [word] if word else []
            word = ""
    return [w.lower() for w in out + ([word] if word else [])]


def strings(n=200, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice("abzAZ09' '-.\n\tüñé<") for _ in range(r.randrange(0, 40))) for _ in range(n)]


def test_tokenize_equals_a_character_loop(spark):
    rows = [(s,) for s in [*strings(), "don't", "rock'n'roll", "'a'b", "it''s me", "", "The Quick-Brown Fox jumps over 2 lazy dogs!"]] + [(None,)]
    for r in spark.createDataFrame(rows, "text string").select("text", tokenize(F.col("text")).alias("t")).collect():
        assert r.t == model_tokens(r.text or ""), r.text


def test_options(spark):
    df = spark.createDataFrame([("the cat sat on the mats running nationally a",)], "text string")
    get = lambda o: df.select(tokenize(F.col("text"), o)).first()[0]
    assert get(AnalyzerOptions(stop_words=True)) == ["cat", "sat", "mats", "running", "nationally"]
    assert get(AnalyzerOptions(stem=True)) == ["the", "cat", "sat", "on", "the", "mat", "runn", "national", "a"]
    assert get(AnalyzerOptions(min_length=4)) == ["mats", "running", "nationally"]


def test_driver_and_column_analysis_agree(spark):
    words = ["running", "relational", "flies", "is", "ties", "boxes", "quickly", "the", "markedly", "as", "sization"]
    options = AnalyzerOptions(stop_words=True, stem=True, min_length=2)
    rows = spark.createDataFrame([(w,) for w in words], "text string").select("text", T.normalize_word(F.col("text"), options).alias("n")).collect()
    assert [r.n for r in rows] == [analyze(r.text, options) for r in rows]


def test_spans(spark):
    df = spark.createDataFrame([(1, "Hello, World!"), (2, "don't"), (3, ""), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.pos, r.word, r.start, r.end) for r in token_spans(df).collect())
    assert got == [(1, 0, "hello", 0, 5), (1, 1, "world", 7, 12), (2, 0, "don", 0, 3), (2, 1, "t", 4, 5)]


def model_snippet(text, terms, w):
    spans = [(m[0].lower(), m.start(), m.end()) for m in re.finditer("[A-Za-z0-9]+", text)]
    squeeze = lambda s: re.sub("[ \t\r\n]+", " ", s).strip(" ")
    if not spans:
        return squeeze(text[:240])
    w = min(w, len(spans)) or len(spans)
    hits = [sum(x[0] in terms for x in spans[i : i + w]) for i in range(len(spans) - w + 1)]
    i = hits.index(max(hits))
    return ("... " if i else "") + squeeze(text[spans[i][1] : spans[i + w - 1][2]]) + (" ..." if i + w < len(spans) else "")


def test_snippets_equal_a_loop(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["the", "of", "x1", "y-z", "ü", "\n"]) for _ in range(r.randrange(0, 70)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for w in (25, 5):
        got = {x.doc_id: x.snippet for x in snippets(df, ["the", "of"], w).collect()}
        assert got == {i: model_snippet(t, {"the", "of"}, w) for i, t in rows}
    assert best_windows(df, []).count() == sum(bool(re.search("[A-Za-z0-9]", t)) for _, t in rows)


def test_escapes(spark):
    row = spark.createDataFrame([("a<b>&\"c\"", "a+b%20c", "%zz+x", " \t x\n\n y ")], "h string, u string, v string, w string")
    got = row.select(T.html_escape(F.col("h")), T.url_decode(F.col("u")), T.url_decode(F.col("v")), T.collapse_whitespace(F.col("w")), T.highlight(F.lit("The apple & a cat"), ["apple", "the"])).first()
    assert list(got) == ["a&lt;b&gt;&amp;&quot;c&quot;", "a b c", "%zz x", "x y", "<mark>The</mark> <mark>apple</mark> &amp; <mark>a</mark> cat"]


def test_sorted_postings_of_every_word(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(7, "Zebra apple's zoo"), (3, "apple Banana b"), (5, "zoo zoo 9 a"), (9, None), (1, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in sorted(rows):
        for w in set(model_tokens(t or "")):
            want.setdefault(w, []).append(i)
    got = {r.term: r.docs for r in entry.queries()["postings_sorted"](spark, str(tmp_path)).collect()}
    assert got == want and {"zebra", "banana", "b"} < set(got)
