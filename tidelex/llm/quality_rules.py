"""Quality rules, with built-in functions only: base counts and a log-likelihood ratio of hashed n-grams.

Words and pairs of words are hashed into 2**16 cells. Two multinomials over the cells are counted over all
documents: the raw corpus, and the trusted target, which is the documents whose label says quality 1. A
text's verdict is the mean over its n-grams of log p_target - log p_raw; it is kept if that is at least
``threshold``. The target is smoothed towards the raw counts, so that a cell seen seldom says little.

n_repeat_words is counted within each text: hashes of its 3-word windows are sorted together with their
positions, neighbours with equal hashes mark their windows, and the marked words are added up.

Edge cases: null and empty texts have no words and fail the base rule; rows with null doc_id count in the
raw corpus only; a doc_id whose labels disagree counts as trusted if one of them says quality 1; without
trusted documents every ratio is 0. Each row is judged alone, so repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
THRESHOLD = -0.06
PRIOR = 8.0
FEW_LABELS = 2_000_000
_BLANKS = " \\t\\n\\u000b\\u000c\\r"


def _let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it by name in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


_HASHES = r"transform(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0), w -> xxhash64(w))"
_PAIRS = "IF(size(h) < 2, array(), transform(slice(h, 1, size(h) - 1), (x, i) -> xxhash64(x, h[i + 1])))"
_CELL = f"CAST(x & {(1 << BITS) - 1} AS INT)"
_REPEATS = _let(
    "g",
    "IF(size(h) < 3, array(), transform(slice(h, 1, greatest(size(h) - 2, 0)), (x, i) -> xxhash64(x, h[i + 1], h[i + 2])))",
    "IF(size(array_distinct(g)) = size(g), 0L, "
    + _let(
        "s",
        "sort_array(transform(g, (x, i) -> named_struct('x', x, 'i', i)))",
        _let(
            "p",
            "sort_array(transform(filter(s, (v, j) -> coalesce(v.x = get(s, j - 1).x, false) OR coalesce(v.x = get(s, j + 1).x, false)), v -> CAST(v.i AS BIGINT)))",
            "aggregate(transform(p, (a, j) -> coalesce(least(3L, get(p, j + 1) - a), 3L)), 0L, (a, x) -> a + x)",
        ),
    )
    + ")",
)


def _cells(docs: DataFrame) -> DataFrame:
    """One row an n-gram: its cell, and whether its text is trusted."""
    both = _let("h", _HASHES, f"concat(h, {_PAIRS})")
    return docs.select("trusted", F.explode(F.expr(f"transform({both}, x -> {_CELL})")).alias("cell"))


def ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the array of the cells' log ratios. 2**16 doubles, whatever the corpus."""
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long")).distinct().withColumn("trusted", F.lit(1))
    if labels.count() <= FEW_LABELS:  # 16 bytes each at most; more are joined by shuffling
        trusted = F.broadcast(trusted)
    marked = docs.join(trusted, "doc_id", "left").select("text", F.coalesce("trusted", F.lit(0)).alias("trusted"))
    counts = _cells(marked).groupBy("cell").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    cells = docs.sparkSession.range(1 << BITS).select(F.col("id").cast("int").alias("cell")).join(counts, "cell", "left")
    every = cells.agg(F.sort_array(F.collect_list(F.struct("cell", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))).alias("c"))
    sums = every.selectExpr("c", "aggregate(c, 0D, (a, x) -> a + x.raw) AS n_raw", "aggregate(c, 0D, (a, x) -> a + x.target) AS n_target")
    share = f"(x.raw + 1D) / (n_raw + {1 << BITS})"
    prior = f"{PRIOR * (1 << BITS)}D"
    return sums.selectExpr(f"transform(c, x -> IF(n_target = 0, 0D, ln((x.target + {prior} * {share}) / (n_target + {prior})) - ln({share}))) AS ratio")


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio) of
    ``docs(doc_id, text)`` by ``labels(doc_id, quality)``."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    table = ratios(docs, labels).scalar()
    mean = f"IF(size(h) = 0, 0D, (aggregate(h, 0D, (a, x) -> a + r[{_CELL}]) + aggregate({_PAIRS}, 0D, (a, x) -> a + r[{_CELL}])) / (2 * size(h) - 1))"
    made = _let("h", _HASHES, f"named_struct('n_words', CAST(size(h) AS BIGINT), 'n_repeat_words', {_REPEATS}, 'ratio', {mean})")
    lines = _let("l", f"filter(split(coalesce(text, ''), '\\n'), x -> translate(x, '{_BLANKS}', '') <> '')", "CAST(size(l) - size(array_distinct(l)) AS BIGINT)")
    out = docs.withColumn("__r", table).select(
        "doc_id",
        F.expr(f"transform(array(__r), r -> {made})[0]").alias("m"),
        F.expr(f"CAST(length(translate(coalesce(text, ''), '{_BLANKS}', '')) AS BIGINT)").alias("word_chars"),
        F.expr("CAST(length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS BIGINT)").alias("n_symbols"),
        F.expr(lines).alias("n_dup_lines"),
    )
    out = out.select("doc_id", "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", "m.ratio")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("ratio") >= threshold)).alias("kept"), "ratio")
