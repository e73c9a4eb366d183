import re

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import os

    if not os.path.isdir(DATA):
        pytest.skip("the test tables are not here")
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], DATA).cache())
    return out


def test_each_stage_takes_effect_and_keeps_the_columns(stages):
    counts = [d.count() for d in stages]
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in stages[:-1])
    assert counts[0] >= counts[1] >= counts[2] > counts[3] == counts[4] > 100


def test_near_duplicates_and_passages_are_gone(stages):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    before = {r.doc_id: word.findall(r.text) for r in stages[3].collect()}
    seen, want = {}, {}
    for i in sorted(before):
        w = before[i]
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), i) < i:
                keep[k : k + 50] = [False] * 50
        want[i] = [x for x, y in zip(w, keep) if y]
    assert {r.doc_id: word.findall(r.text) for r in stages[4].collect()} == want
    tokens = stages[5].groupBy("doc_id").sum("length").count()
    assert tokens == stages[4].count()


def test_empty_table(spark, stages):
    import corpus_pipeline

    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_near_duplicates_are_those_of_five_words_and_four_fifths(spark):
    import random

    import corpus_pipeline

    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = [[word() for _ in range(500)] for _ in range(12)]
    for k in range(12):  # 10 to 12 scattered words changed, on either side of the threshold
        copy = list(texts[k])
        for at in range(20, 20 + 40 * (10 + k % 3), 40):
            copy[at] = word()
        texts.append(copy)
    texts += [texts[0][:4], texts[0][:4], texts[1][:3] + ["other"]]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    up = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                up = [up[b] if u == up[a] else u for u in up]
    want = {min(i for i, v in enumerate(up) if v == u) for u in up}
    assert 12 < len(want) < 26
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id for x in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, DATA).collect()} == want


def test_quality_stage_removes_bad_texts_only(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, ("plain words of a text " if i % 3 else "#!! b%d ^^ zz&& ") * (4 + i % 5), None, "s", 1) for i in range(120)] + [(500, "plain words of a text", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("more", F.lit(1))
    spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.keep_good_quality(spark, docs, str(tmp_path))
    assert got.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in got.collect()} == {i for i in range(120) if i % 3} | {500}


def test_run_leaves_only_its_stages_in_the_shared_folder(spark, tmp_path, monkeypatch):
    import os

    import corpus_pipeline
    from tidelex import storage

    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(tmp_path))
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert sorted(x.rsplit("-", 1)[0] for x in os.listdir(tmp_path)) == sorted(f"stage-{name}" for name, _ in corpus_pipeline.STAGES[:-1])
