import random

import pytest

from tidelex.plans.index import SearchIndex, postings_of, tokens
from tidelex.plans.query import And, Or, Phrase, QueryParseError, Word, compile_query, lex, parse
from tidelex.operators import boolean as B

DOCS = [(0, "the quick brown fox"), (1, "the quick fox jumps"), (2, "brown fox jumps over"), (3, "lazy dog sleeps")]


@pytest.fixture(scope="module")
def postings(spark):
    return postings_of(tokens(spark.createDataFrame(DOCS, "doc_id long, text string"))).cache()


@pytest.mark.parametrize(
    "text,ids",
    [
        ("quick fox", [0, 1]), ("quick AND fox", [0, 1]), ("brown OR lazy", [0, 2, 3]), ("fox -brown", [1]), ("fox NOT brown", [1]), ('"quick fox"', [1]), ('"brown fox"', [0, 2]),
        ("(quick OR lazy) AND NOT dog", [0, 1]), ("nosuchword", []), ('"fox nosuchword"', []), ("fox -nosuchword", [0, 1, 2]), ('fox -"quick brown"', [1, 2]), ("QUICK", [0, 1]),
    ],
)
def test_queries(postings, text, ids):
    assert sorted(r.doc_id for r in compile_query(text).matches(postings).collect()) == ids


@pytest.mark.parametrize("text", ["", "  ", "-brown", "(quick OR fox", "quick)", "AND x", "x OR", "NOT NOT x", "()", '""', "...", "(-a) b", "a OR -b"])
def test_errors(text):
    with pytest.raises(QueryParseError):
        parse(text)


def test_trees():
    assert parse("a b") == And((Word("a"), Word("b")))
    assert parse("a") == Word("a") and parse("(a OR b)") == Or((Word("a"), Word("b")))
    assert parse('"a-b') == Phrase(("a", "b"))
    assert compile_query("quick -brown").terms == ["quick"]
    assert compile_query('a a "a b" (c -d)').counts == {"a": 3, "b": 1, "c": 1}
    assert compile_query("don't").words == ["dont"]
    assert lex("well-known") == [("word", "well"), ("NOT", "-"), ("word", "known")]


def evaluate(node, words):
    if isinstance(node, Word):
        return node.word in words
    if isinstance(node, Phrase):
        return any(words[i : i + len(node.words)] == list(node.words) for i in range(len(words)))
    if isinstance(node, Or):
        return any(evaluate(c, words) for c in node.choices)
    return all(evaluate(c, words) for c in node.required) and not any(evaluate(c, words) for c in node.excluded)


def random_query(r, depth=0):
    kind = r.random()
    if depth > 2 or kind < 0.4:
        return r.choice("abcd")
    if kind < 0.55:
        return '"' + " ".join(r.choice("abcd") for _ in range(r.randrange(1, 4))) + '"'
    if kind < 0.75:
        return "(" + " OR ".join(random_query(r, depth + 1) for _ in range(2)) + ")"
    return "(" + random_query(r, depth + 1) + r.choice([" ", " AND ", " -"]) + random_query(r, depth + 1) + ")"


def test_random_trees_equal_direct_evaluation(spark):
    r = random.Random(5)
    docs = [(i, [r.choice("abcde") for _ in range(r.randrange(1, 8))]) for i in range(40)]
    rows = postings_of(tokens(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"))).cache()
    for _ in range(25):
        text = random_query(r)
        got = sorted(x.doc_id for x in compile_query(text).matches(rows).collect())
        assert got == [i for i, w in docs if evaluate(parse(text), w)], text


def test_relational_operators(postings):
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    fox, quick = B.term(postings, "fox"), B.term(postings, "quick")
    assert ids(B.both(fox, quick)) == [0, 1] and ids(B.either(quick, B.term(postings, "dog"))) == [0, 1, 3] and ids(B.without(fox, quick)) == [2]
    assert ids(B.phrase(postings, ["brown", "fox"])) == [0, 2] and ids(B.all_of(postings, ["fox", "jumps"])) == [1, 2] and ids(B.any_of(postings, ["dog", "over"])) == [2, 3]


def test_index_round_trip_ranking_and_rank_order(spark, tmp_path):
    from tidelex.functions.text import AnalyzerOptions
    from tidelex.operators.pagerank import pagerank

    corpus = spark.createDataFrame([(i, f"doc://{i}", "", f"Doc {i}", t) for i, t in DOCS], "doc_id long, url string, path string, title string, text string")
    links = spark.createDataFrame([(0, "doc://1"), (0, "doc://1"), (1, "doc://none")], "src long, url string")
    index = SearchIndex.build(corpus, AnalyzerOptions(stem=True), links).save(str(tmp_path / "i"))
    assert index.options.stem and index.size() == 4 and [tuple(r) for r in index.edges.collect()] == [(0, 1), (0, 1)]
    assert index.document_frequency(["fox", "missing"]) == {"fox": 3, "missing": 0} and index.document(999).count() == 0
    hits = [r.doc_id for r in index.search("quick OR fox").collect()]
    assert hits.index(0) < hits.index(2) and [r.doc_id for r in index.search("sleeping OR jumping").collect()]
    index.save_pagerank(pagerank(index.docs, index.edges), str(tmp_path / "i"))
    again = SearchIndex.load(spark, str(tmp_path / "i"))
    assert again.pagerank is not None and abs(again.pagerank.agg({"score": "sum"}).first()[0] - 1) < 1e-9
    again.index_id = "other"
    assert again.search("fox").count() == 3


def test_all_postings_lex_a_text_once_and_move_it_only(spark, tmp_path):
    from tidelex import catalog

    rows = [(1, "b a b"), (2, None), (3, ""), (1, "a c"), (4, "- -")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = catalog.postings_positions(spark, str(tmp_path))
    planned = made._jdf.queryExecution().executedPlan().toString()
    assert planned.count("regexp_extract_all") == 1
    assert planned.count("Exchange hashpartitioning") == planned.count("Exchange hashpartitioning(doc_id") == 1
    assert sorted(tuple(r) for r in made.collect()) == [("a", 1, [0, 1]), ("b", 1, [0, 2]), ("c", 1, [1])]
    assert sorted(tuple(r) for r in catalog.postings_tf(spark, str(tmp_path)).collect()) == [("a", 1, 2), ("b", 1, 2), ("c", 1, 1)]
