import random

import numpy as np
import pyarrow as pa
import pytest

from tidelex.llm import textkit as K
from tidelex.llm.bpe import bpe_round_trip
from tidelex.llm.language_id import language_id
from tidelex.llm.licenses import license_scan
from tidelex.llm.ngram_join import ngram_components
from tidelex.llm.packing import pack
from tidelex.llm.queries import vocabulary
from tidelex.llm.shared import BATCH_BYTES, small_batches
from tidelex.llm.substring_dedup import substring_dedup

BOUND, OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


@pytest.fixture
def bound(spark):
    yield lambda value: spark.conf.set(BOUND, value)
    spark.conf.set(BOUND, OWN)


def test_small_batches_respect_the_session(spark, bound):
    bound(OWN)
    small_batches(spark)
    assert spark.conf.get(BOUND) == str(BATCH_BYTES)
    bound("12345")
    small_batches(spark)
    assert spark.conf.get(BOUND) == "12345"


def test_results_hold_for_any_batches(spark, bound):
    """One row a batch gives what large batches give."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choices(words, k=70))
    texts = [" ".join(r.choices(words, k=r.choice([0, 1, 60, 200]))) for _ in range(60)]
    texts += [f"{t} {passage}" for t in texts[:20]] + texts[20:30] + [None, "", "Released under the MIT License."]
    docs = spark.createDataFrame([(i, t, "de" if i % 2 else "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(2)

    def results():
        packed = pack(docs, vocabulary("byte_bpe_50k.json")).groupBy("doc_id", "doc_tokens").sum("length")
        made = (substring_dedup(docs), ngram_components(docs, 5, 4, 5), language_id(docs), license_scan(docs), packed, bpe_round_trip(docs, vocabulary("word_bpe_49k.json")))
        return [sorted(map(tuple, df.collect()), key=repr) for df in made]

    bound(OWN)
    large = results()
    bound("1")
    assert results() == large


def test_slices_are_even_and_bounded():
    r = random.Random(4)
    texts = ["x" * r.randrange(2000) for _ in range(500)] + [None, "", "y" * 90_000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    parts = list(K.slices(batch, "text", 50_000))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    sizes = np.array([sum(len(t or "") for t in p.column(0).to_pylist()) for p in parts])
    assert (sizes[:-1] <= 50_000).all() and sizes[-1] >= 90_000
    assert list(K.slices(batch.slice(0, 0), "text")) == []
    nothing = pa.RecordBatch.from_arrays([pa.array([None, ""], pa.string())], names=["text"])
    assert [p.num_rows for p in K.slices(nothing, "text")] == [2]


def test_one_model_a_process():
    made = []

    def make(name):
        made.append(name)
        return name

    assert [K.model(k, lambda k=k: make(k)) for k in "aabba"] == list("aabba")
    assert made == ["a", "b", "a"] and len(K._MODEL) == 1
    assert K.model("none", lambda: None) is None
