"""Brute-force versions beside each operator, with nulls, empty and long texts, ties and odd columns."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelex.llm import ngram_join
from tidelex.llm import textkit as K
from tidelex.llm.bpe import bpe_round_trip
from tidelex.llm.bpe_stream import Decoder, Transducer, WordEncoder
from tidelex.llm.language_id import CrossParser, automaton, language_id
from tidelex.llm.licenses import TEMPLATES, align, best_alignment, license_scan, longest_rise, regions, words_of
from tidelex.llm.ngram_join import ngram_components
from tidelex.llm.packing import pack
from tidelex.llm.quality import quality_scores
from tidelex.llm.quality_rules import quality_rules
from tidelex.llm.queries import vocabulary
from tidelex.llm.substring_dedup import substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0, n=60):
    """Random texts with copies, near copies, shared passages, repeated rows, null and empty texts, one long text."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéßñ") for _ in range(r.randrange(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(vocab) + r.choice(["", "", ".", "!"]) for _ in range(k))
    passage = text(70)
    rows = [text(r.randrange(0, 200)) for _ in range(n)]
    for i in range(0, n, 5):
        rows[i] = rows[i] + "\n" + passage + "\t" + text(9)
    for i in range(1, n, 6):
        words = rows[(i * 7) % n].split(" ")
        words[len(words) // 2] = "edit"
        rows[i] = " ".join(words)
    rows += [rows[3], rows[3].upper(), "", " \t\n", "x", "x y", "X Y", text(6000), "\x85a\xa0b\x1cc " + passage, "日本 語 🙂"]
    out = [(i * 3 % 211, t, "en" if i % 2 else "de", "s", len(t)) for i, t in enumerate(rows)]
    return [*out, (500, None, "en", "s", None), out[4], (None, rows[3], None, None, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).withColumn("score", F.lit(1)).withColumn("fa", F.lit("clash")).repartition(3)


def hexsha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def test_word_kernels_equal_the_pattern():
    import pyarrow as pa

    texts = [t for _, t, *_ in corpus()]
    data, offsets = K.text_buffers(pa.array(texts))
    starts, ends, words = K.word_spans(data, offsets)
    for i, t in enumerate(texts):
        got = [bytes(data[a:b]).decode() for a, b in zip(starts[words[i] : words[i + 1]], ends[words[i] : words[i + 1]])]
        assert got == WORDS.findall(t or "")
    h = K.word_hashes(data, starts, ends)
    assert len(set(h.tolist())) == len({bytes(data[a:b]) for a, b in zip(starts, ends)})
    win = K.window_hashes(h, 3)
    assert (win == K.window_hashes(h, 3, block=17)).all() and len(set(win.tolist())) == len({tuple(h[i : i + 3]) for i in range(len(h) - 2)})


def test_substring_dedup(docs):
    least = {}
    rows = [(i, WORDS.findall(t or ""), t) for i, t, *_ in corpus()]
    for i, w, _ in rows:
        for k in range(len(w) - 49) if i is not None else ():
            least[tuple(w[k : k + 50])] = min(i, least.get(tuple(w[k : k + 50]), i))
    want = []
    for i, w, t in rows:
        keep = [True] * len(w)
        for k in range(len(w) - 49) if i is not None else ():
            if least[tuple(w[k : k + 50])] < i:
                keep[k : k + 50] = [False] * 50
        left = " ".join(x for x, y in zip(w, keep) if y)
        want.append((i, len(w), len(w) - sum(keep), hexsha(left), t if all(keep) else left, "s" if i is not None else None))
    got = [tuple(r) for r in substring_dedup(docs, with_text=True, carry=("source",)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(x[2] for x in want) > 500
    few = [tuple(r) for r in substring_dedup(docs, map_bits=15).collect()]  # a full map changes nothing
    assert sorted(few, key=str) == sorted([x[:4] for x in want], key=str)
    twice = [tuple(r) for r in substring_dedup(docs, range_bytes=100, fan_out=8).collect()]  # many ranges, in two steps
    assert sorted(twice, key=str) == sorted([x[:4] for x in want], key=str)


def test_substring_dedup_of_one_doc_id_with_two_texts(spark):
    word = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    rows = [(1, word(1)), (5, word(1)), (5, word(2)), (7, word(2)), (7, word(3)), (9, word(4)), (9, word(4))]
    for parts in (1, 4):  # in one slice or in several
        got = Counter(map(tuple, substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).select("doc_id", "n_removed").collect()))
        assert got == {(1, 0): 1, (5, 80): 1, (5, 0): 1, (7, 80): 1, (7, 0): 1, (9, 0): 2}


def test_packed_windows_are_read_back():
    from tidelex.llm import substring_dedup as S

    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2) + rng.integers(0, 2, 5000, np.uint64)
    doc, place = rng.integers(-9, 9, 5000) << 40, rng.integers(0, 1 << 20, 5000)
    for bits in (8, 10, 17):
        rows = [dict(zip([x.split()[0] for x in S.PACKED.split(", ")], r)) for r in S._of_ranges(h, doc, place, bits)]
        found = [np.concatenate(x) for x in zip(*(S._of_range(r, bits) for r in rows))]
        assert Counter(zip(*(x.tolist() for x in found))) == Counter(zip(h.tolist(), doc.tolist(), place.tolist()))


def shingles(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) or (frozenset([tuple(w)]) if w else frozenset())


@pytest.mark.parametrize("group", [256, 2])
def test_ngram_join(spark, group):
    rows = corpus(7, 120)
    r = random.Random(2)
    base = [r.choice("abcdefghijklmnopq") * 3 + str(r.randrange(99)) for _ in range(200)]
    for k in range(40):  # a chain of near copies, each a little further from the first
        base[r.randrange(200)] = f"w{k}"
        rows.append((1000 + k, " ".join(base), "en", "s", 1))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("token", F.lit("clash"))
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 90 * len(s | t):
                up[max(find(i), find(j))] = min(find(i), find(j))
    want = Counter((i, len(s), find(i) if i is not None else None) for i, s in sets)
    assert Counter(tuple(r) for r in ngram_components(docs, group=group, range_bytes=20_000 if group == 2 else 1 << 20).collect()) == want
    assert len({c for _, _, c in want}) < len(want) - 30


@pytest.mark.parametrize("limit", [{}, {"pass_bytes": 30_000}])
def test_ngram_join_opens_few_cells(spark, monkeypatch, limit):
    """A line that short and long texts have makes no class ask every group of that line, and opened groups are dealt to passes."""
    r = random.Random(5)
    line = " ".join(f"line{k}" for k in range(15))
    rows = []
    for k in range(40):
        rows.append((len(rows), f"{line} " + " ".join(f"{k}x{r.randrange(10**6)}" for _ in range(5))))
    for k in range(80):
        words = [f"{k}x{r.randrange(10**6)}" for _ in range(85 + 3 * k)]
        for changes in (0, 1, 1 + len(words) // 30):  # the first two link if long enough, the third is too far from both
            for place in range(changes):
                words[place * len(words) // changes] = f"new{len(rows)}x{place}"
            rows.append((len(rows), line + "\n" + " ".join(words)))
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))
    for a, s in enumerate(sets):
        for b, t in enumerate(sets[:a]):
            if 100 * len(s & t) >= 90 * len(s | t):
                low, high = sorted((up[a], up[b]))
                up = [low if x == high else x for x in up]
    tables = []

    def stored(df, name, write=ngram_join.stored):
        tables.append((name, out := write(df, name)))
        return out

    monkeypatch.setattr(ngram_join, "stored", stored)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_components(docs, group=8, **limit).collect()}
    assert got == {i: (len(s), up[i]) for i, s in enumerate(sets)}
    assert 50 < len(set(up)) < len(rows) - 50
    assert next(t for name, t in tables if name == "cells").count() < 2 * len(rows)
    across = [name for name, _ in tables][[name for name, _ in tables].index("cells") + 1 :].count("links")
    assert across > 1 if limit else across == 1


def test_language_id(spark):
    r = random.Random(4)
    syllables = {"aa": ["ba", "lo", "mi", "tu"], "bb": ["stra", "ke", "ung", "zz"], "cc": ["é", "que", "ñi", "lo"]}
    text = lambda k, n: " ".join("".join(r.choice(syllables[k]) for _ in range(r.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(k, r.randrange(3, 60)), k, None, 1) for i in range(300) for k in [r.choice(list(syllables))]]
    rows += [(900, None, "aa", "s", 1), (901, "", "aa", "s", 1), (902, "123 !? \n", "aa", "s", 1), (903, text("bb", 9000), None, "s", 1), (None, text("cc", 30), "cc", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cost", F.lit(1)).withColumn("place", F.lit(2))
    got = language_id(df).collect()
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 if i is not None else False for i, *_ in rows}
    assert all(x.held_out == held[x.doc_id] and 0 <= x.score <= 1 for x in got) and len(got) == len(rows)
    said = {x.doc_id: x.lang_pred for x in got}
    assert [said[k] for k in (900, 901, 902, 903, None)] == ["und", "und", "und", "bb", "cc"]
    test = [(i, k) for i, _, k, *_ in rows[:300] if held[i]]
    assert sum(said[i] == k for i, k in test) >= 0.97 * len(test)
    assert {x.lang_pred for x in language_id(df.where("lang IS NULL")).collect()} == {"und"} and language_id(df.limit(0)).count() == 0


def test_cross_parsing_equals_greedy_matching():
    train = [("x", "abra cadabra banana"), ("y", "nabab rabac")]
    parser = CrossParser(train)
    texts = ["abracadabra", "", "banana nab", "zzz", "A-b?C", "cada " * 200]
    total, sizes, letters = parser.phrases(texts)
    for k, (_, source) in enumerate(train):
        source = f" {source} "
        for i, t in enumerate(texts):
            s = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " ")
            count = 0
            for lo in range(0, len(s), 256):
                part, at = s[lo : lo + 256], 0
                while at < len(part):
                    n = 1
                    while at + n < len(part) and part[at : at + n + 1] in source:
                        n += 1
                    at, count = at + n, count + 1
            assert total[k, i] == count, (k, t)
    moves = automaton([ord(c) for c in "banana"])
    for a in range(6):
        for b in range(a + 1, 7):
            s = 0
            for c in "banana"[a:b]:
                s = moves[s][ord(c)]


def test_quality(spark):
    r = random.Random(6)
    text = lambda bad: " ".join(("".join(r.choice("abcde") for _ in range(4)) + ("!!" if bad and r.random() < 0.7 else "")) for _ in range(r.randrange(5, 80)))
    rows = [(i, text(i % 4 == 0), None, None, 1) for i in range(400)] + [(900, None, None, None, 1), (901, "", None, None, 1), (None, "x", None, None, 1), (902, "w " * 30_000, None, None, 1)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400) if i % 5] + [(900, 1, 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(spark.createDataFrame(rows, SCHEMA).withColumn("quality", F.lit("clash")), labels).collect()
    held = [x for x in got if x.held_out and x.doc_id < 400]
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    assert sum(x.predicted == int(x.doc_id % 4 != 0) for x in held) >= 0.97 * len(held) and len(got) == len(rows)
    same = {x.doc_id: x.score for x in got}
    assert same[900] == same[901]
    none = quality_scores(spark.createDataFrame(rows[:3], SCHEMA), labels.limit(0)).collect()
    assert [x.score for x in none] == [0.5] * 3


def test_quality_equals_a_plain_loop(spark):
    """Weights by a loop over dictionaries, scores by a sum over the words of one text."""
    from tidelex.llm import quality as Q

    one = lambda x: K.word_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]
    mix = lambda x: int(K.mix(np.array([x % (1 << 64)], np.uint64))[0])

    def entries(text):
        words = [w.encode() for w in WORDS.findall(text or "")]
        h = [int(one(w)) for w in words]
        shapes = []
        for k, w in enumerate(words):
            kinds = bytes(97 if c > 127 else 48 if 48 <= c < 58 else 65 if 65 <= c < 91 else 97 if 97 <= c < 123 else c for c in w)
            short = bytes(c for j, c in enumerate(kinds) if j == 0 or c != kinds[j - 1])
            shapes.append(0x1234567 if k and words[k - 1] == w else int(one(short)))
        pair = lambda x: [mix(a * 3 + b) for a, b in zip(x, x[1:])]
        three = [mix(a * 5 + b) for a, b in zip(pair(shapes), shapes[2:])]
        out = {1 << Q.BITS: 1.0}
        for k, values in enumerate((h, pair(h), shapes, pair(shapes), three)):
            for v, c in Counter(mix(v ^ int(Q._SALT[k])) >> (64 - Q.BITS) for v in values).items():
                out[v] = out.get(v, 0.0) + c / math.sqrt(len(values))
        return out

    r = random.Random(3)
    texts = [" ".join(r.choice(["ab", "Ab1", "c!!", "é", "x-y", "c!!"]) for _ in range(r.randrange(0, 30))) for _ in range(30)]
    labels = [r.randrange(2) for _ in texts]
    z, n, alpha, beta, l1, l2 = Counter(), Counter(), 0.3, 1.0, 0.02, 0.2
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(2):
        for t, y in zip(texts, labels):
            x = entries(t)
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    weights, bias = Q.train(list(zip(texts, labels)))
    assert abs(bias - weight(1 << Q.BITS)) < 1e-9 and all(abs(weights[i] - weight(i)) < 1e-9 for i in z if i < 1 << Q.BITS) and np.count_nonzero(weights) <= len(z)
    import pyarrow as pa

    got = Q.scores(weights, bias, *K.text_buffers(pa.array(texts)))
    assert all(abs(s - 1 / (1 + math.exp(-sum(weight(i) * v for i, v in entries(t).items())))) < 1e-9 for s, t in zip(got, texts))
    for k in (0, 7, 29):  # the same to the last bit wherever the text stands
        for around in (texts[:k], texts[k:], ["", texts[3] * 9, ""]):
            assert Q.scores(weights, bias, *K.text_buffers(pa.array([*around, texts[k], "x"])))[-2] == got[k]


def test_quality_learns_from_long_texts_within_its_bound(spark):
    from tidelex.llm import quality as Q

    rows = [(i, ("good words here " if i % 2 else "bad!! stuff%% ") * (25_000 if i < 2 else 3), None, None, 1) for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    long = [r for r in rows if len(r[1]) > 200_000]
    assert long
    only = labels.where(F.col("doc_id").isin([r[0] for r in long]))
    assert np.count_nonzero(Q.fit(docs, only)[0]) > 0 and np.count_nonzero(Q.fit(docs, only, sample_bytes=10)[0]) > 0
    few, many = Q.fit(docs, labels, sample_bytes=200), Q.fit(docs, labels)
    assert not np.array_equal(few[0], many[0])


def test_quality_rules(spark, docs):
    xxhash = pytest.importorskip("xxhash")
    rows = corpus()
    labels = [(i, int(i % 3 != 0)) for i, *_ in rows if i is not None and i % 2] + [(9, 0), (9, 1), (None, 1)]
    got = quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def hash_longs(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
        return signed(seed)

    cells = {}
    for k, (i, t, *_) in enumerate(rows):
        h = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in WORDS.findall(t or "")]
        cells[k] = [x & 65535 for x in h] + [hash_longs(p) & 65535 for p in zip(h, h[1:])]
    trusted = {i for i, q in labels if q == 1 and i is not None}
    raw, target = Counter(), Counter()
    for k, (i, *_) in enumerate(rows):
        raw.update(cells[k])
        target.update(cells[k] if i in trusted else [])
    n_raw, n_target, prior = sum(raw.values()), sum(target.values()), 8.0 * 65536
    want = []
    for k, (i, t, *_) in enumerate(rows):
        w = WORDS.findall(t or "")
        share = lambda c: (raw[c] + 1) / (n_raw + 65536)
        score = sum(math.log((target[c] + prior * share(c)) / (n_target + prior)) - math.log(share(c)) for c in cells[k]) / max(1, len(cells[k]))
        three = Counter(zip(w, w[1:], w[2:]))
        marked = {j + a for j in range(len(w) - 2) if three[tuple(w[j : j + 3])] > 1 for a in range(3)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(marked), failed, not failed and score >= -0.06, round(score, 9)))
    assert sorted(([*r[:8], round(r.ratio, 9)] for r in got), key=str) == sorted(map(list, want), key=str)
    assert quality_rules(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_quality_rules_plan_has_no_python(spark, docs):
    plan = quality_rules(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    rows = sorted(pack(docs, path, with_ids=True).collect(), key=lambda r: (r.sequence_id, r.offset))
    fill = Counter()
    for r in rows:
        assert r.offset == fill[r.sequence_id] and r.length == len(r.ids) and zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) == r.ids_crc32
        fill[r.sequence_id] += r.length
    kinds = {}
    for r in rows:
        kinds.setdefault(r.sequence_id, []).append((r.bin_class, r.length))
    for found in kinds.values():  # k pieces of class k, or a sequence of the partition's end
        k = found[0][0]
        assert all(c == k for c, _ in found) and (k == 0 or len(found) == k and all(1024 / (k + 1) < n <= 1024 / k for _, n in found))
    open_ends = [s for s, found in kinds.items() if found[0][0] == 0 and fill[s] < 1024]
    assert len(open_ends) <= 3 and len({s >> 33 for s in open_ends}) == len(open_ends)  # one for each of three partitions
    whole = Counter()
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    want = Counter()
    for i, t, *_ in corpus():
        ids = slow.encode(t or "", add_special_tokens=False).ids + [0]
        want[i, len(ids), tuple(ids)] += 1
    for (i, n), found in pieces.items():
        copies = Counter(s for s, _ in found)[0]
        text, at = [], 0
        while at < n:
            part = next(x for s, x in found if s == at)
            text, at = text + part, at + len(part)
        whole[i, n, tuple(text)] = copies
    assert whole == want
    odd = ["<|endoftext|> a", "a" * 30_000, " " * 30_000, "x \n\n y", "🙂é"]
    from tidelex.llm.packing import tokenizer

    odd += [("word \n\n  and  " * 9000) + "<|endoftext|>" + "x's 12" * 20_000]  # of several pieces
    assert all(tokenizer(path).ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids for t in odd)


def test_packing_cuts_only_where_it_is_worth_it():
    from tidelex.llm.packing import PIECES, WORTH, cut, cut_of, unused

    for rest in range(1, 1024):
        found = cut_of(rest, 1024)
        assert sum(found) == rest and 1 <= len(found) <= PIECES
        left = sum(unused(x, 1024) for x in found)
        assert left + WORTH * (len(found) - 1) <= unused(rest, 1024)
        two = min((unused(k, 1024) + unused(rest - k, 1024) for k in {1024 // k for k in range(2, 40)} if k < rest), default=math.inf)
        assert left + WORTH * (len(found) - 1) <= two + WORTH
    assert cut(3 * 1024 + 512, 1024) == [1024, 1024, 1024, 512] and cut(1024, 1024) == [1024] and cut(1, 1024) == [1]


def test_packing_encodes_each_of_many_words_once():
    from tokenizers import Tokenizer

    from tidelex.llm.packing import LibraryIds

    path = vocabulary("byte_bpe_50k.json")
    own, encoded = LibraryIds(path), []
    plain = own.known.encode
    own.known.encode = lambda word: encoded.append(word) or plain(word)
    text = " ".join("".join("abcdefghij"[int(d)] for d in str(i)) for i in range(150_000)) + " a\x7fb\t\x01 ~!\"' \xa0 é"
    first, second = own.ids(text), own.ids(text)
    assert len(encoded) == len(set(encoded)) > 150_000 and first.tolist() == second.tolist()
    assert first.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_splitting_below_the_other_planes():
    import regex

    from tidelex.llm.packing import PATTERN
    from tidelex.llm.pretokens import judged_otherwise, splitter

    r = random.Random(5)
    points = [chr(p) for p in [*range(0xD800), *range(0xE000, 0x10000)]]
    blanks, table = regex.findall(r"\s", "".join(points)), {ord(c): 0x10FFFF for c in judged_otherwise()}
    doubtful = sorted(judged_otherwise())[:19]
    some = [r.choice([r.choice(points), r.choice(blanks), r.choice("aé1²'s. \n\x1c\x85"), r.choice(doubtful)]) for _ in range(40_000)]
    texts = ["".join(f"a{c}1{c}{c} {c}.{c}'s" for c in points[lo : lo + 4000]) for lo in range(0, len(points), 4000)] + ["".join(some[lo : lo + 200]) for lo in range(0, len(some), 200)]
    for pattern in (PATTERN, r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", r"\w+|\s+", "(?i:'S)|.", r"\p{L}+"):
        split = splitter(pattern)
        for text in texts:
            assert split(text) == [text[m.start() : m.end()] for m in regex.finditer(pattern, text.translate(table))]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_every_code_point(name):
    from tokenizers import Tokenizer

    from tidelex.llm.packing import LibraryIds

    slow = Tokenizer.from_file(vocabulary(name))
    slow.no_truncation()
    slow.no_padding()
    own = WordEncoder(vocabulary(name)) if name.startswith("word") else LibraryIds(vocabulary(name))
    encode = (lambda t: b"".join(own.stream(t))) if name.startswith("word") else (lambda t: own.ids(t).tobytes())
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    for lo in range(0, len(points), 8000):
        text = "x ".join(map(chr, points[lo : lo + 8000]))
        assert encode(text) == np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), hex(points[lo])


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    slow = Tokenizer.from_file(path)
    odd = ["don't I'll <|endoftext|> x<|startoftext|>Y", "ΣΑΣ İstanbul ﬁ 12345 ²½ á \x1c\x85ñ", "th" * 900, "ererstion" * 300, "<|ENDOFTEXT|> <|end", "_a_b", "퟿", "no space" * 30_000, "à b\n" * 40_000 + "<|endoftext|>\u0308 e"]
    more = spark.createDataFrame([(10_000 + k, t, None, None, 1) for k, t in enumerate(odd)], SCHEMA)
    got = bpe_round_trip(docs.select("doc_id", "text").unionByName(more.select("doc_id", "text")), path).collect()
    want = Counter()
    for i, t in [*((i, t) for i, t, *_ in corpus()), *((10_000 + k, t) for k, t in enumerate(odd))]:
        ids = slow.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hexsha(struct.pack(f"<{len(ids)}I", *ids)), hexsha(slow.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in got) == want


def test_transducer_is_incremental_and_bounded():
    e = WordEncoder(vocabulary("word_bpe_49k.json"))
    r = random.Random(8)
    for unit in (["th", "er", "in"], ["a"], list("abcdefgh"), ["ss", "s", "es"]):
        word = "".join(r.choice(unit) for _ in range(1500))
        t, out, most = Transducer(e.merges), [], 0
        for c in word:
            out += t.push(c)
            most = max(most, len(t.text))
        assert most <= 3 * e.merges.lookahead + e.merges.longest
        whole = Transducer(e.merges)
        assert out + t.finish() == whole.push(word) + whole.finish()
    d = Decoder(e.merges.name, suffix=e.merges.suffix)
    ids = [i for w in ("naïve", "🙂") for i in memoryview(e.encode_word(w)).cast("I").tolist()]
    assert "".join(d.push([i]) for i in ids) + d.finish() == "naïve 🙂 "


def test_license_scan(spark):
    mit = TEMPLATES["MIT"]
    cut = " ".join(w for k, w in enumerate(mit.split()) if k % 12)
    rows = [(1, "Intro text.\n" + mit.upper() + "\nmore"), (2, cut), (3, "the software is as is " * 40), (4, None), (5, ""), (6, "x. Released under the MIT License."), (6, "x. Released under the MIT License."), (None, mit)]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))).collect()
    assert Counter((r.doc_id, r.license) for r in got) == {(1, "MIT"): 1, (2, "MIT"): 1, (6, "MIT-line"): 2, (None, "MIT"): 1}
    assert [r.coverage for r in got if r.doc_id == 1] == [1.0] and [0.8 < r.coverage < 1 for r in got if r.doc_id == 2] == [True]
    a, b = words_of(cut), words_of(mit)
    found = align(a, b)
    assert all(a[i] == b[j] for i, j in found) and all(x < y for x, y in zip(found, found[1:])) and all(x[1] < y[1] for x, y in zip(found, found[1:]))
    r = random.Random(0)
    for _ in range(30):
        v = [r.randrange(20) for _ in range(9)]
        picks = [[v[i] for i in range(9) if m >> i & 1] for m in range(1 << 9)]
        best = max(len(s) for s in picks if all(x < y for x, y in zip(s, s[1:])))
        k = longest_rise(v)
        assert k == sorted(k) and [v[i] for i in k] == sorted({v[i] for i in k}) and len(k) == best


def test_license_given_twice(spark):
    mit, apache = TEMPLATES["MIT"], TEMPLATES["Apache-2.0-line"]
    words = mit.split()
    edited = " ".join(w for k, w in enumerate(words) if k % 9) + " the software"
    rows = [
        (1, f"Intro. {TEMPLATES['MIT-line']} Body text here. {TEMPLATES['MIT-line']} The end."),
        (2, f"first file {mit} some code {mit} the end of the software"),
        (3, f"{apache} {apache}"),
        (4, f"{edited} other words of any person {edited}"),
        (5, f"{edited} in between {mit}"),
        (6, " ".join(words[:60]) + " other words " + " ".join(words[:60])),
        (7, (mit + " and more ") * 30),
        (8, "to the use of any software the person and the copy is in all " * 40 + mit + " of the software to use any copy in all" * 40),
    ]
    got = {(r.doc_id, r.license): r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "MIT-line"), (2, "MIT"), (3, "Apache-2.0-line"), (4, "MIT"), (5, "MIT"), (7, "MIT"), (8, "MIT")}
    m = len(words_of(mit))
    assert all(got[k].coverage == 1.0 for k in got if k != (4, "MIT")) and 0.8 <= got[(4, "MIT")].coverage < 1
    assert (got[(1, "MIT-line")].first_word, got[(1, "MIT-line")].last_word) == (1, 5)
    assert (got[(2, "MIT")].first_word, got[(2, "MIT")].last_word) == (2, 1 + m)
    assert got[(8, "MIT")].last_word - got[(8, "MIT")].first_word == m - 1


def test_alignment_equals_a_plain_recursion():
    def plain(a, b):
        if not a or not b:
            return []
        pairs = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
        rise, ways = [], []  # a longest chain that ends at each pair, and how many there are
        for k, (i, j) in enumerate(pairs):
            before = [m for m in range(k) if pairs[m][1] < j]
            most = max((len(rise[m]) for m in before), default=0)
            rise.append(max((rise[m] for m in before), key=len, default=[]) + [(i, j)])
            ways.append(sum(ways[m] for m in before if len(rise[m]) == most) if before else 1)
        best = max(map(len, rise), default=0)
        if not best:
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            m = 0
            while m < min(len(a), len(b)) - n and a[-1 - m] == b[-1 - m]:
                m += 1
            return [(k, k) for k in range(n)] + [(len(a) - m + k, len(b) - m + k) for k in range(m)]
        if sum(w for x, w in zip(rise, ways) if len(x) == best) > 1:
            return None  # several longest chains: either will do
        chain, out, x, y = next(c for c in rise if len(c) == best), [], 0, 0
        for i, j in [*chain, (len(a), len(b))]:
            inner = plain(a[x:i], b[y:j])
            if inner is None:
                return None
            out += [(x + p, y + q) for p, q in inner] + ([(i, j)] if i < len(a) else [])
            x, y = i + 1, j + 1
        return out

    r, told = random.Random(5), 0
    for _ in range(600):
        b = [r.choice("abcdefghijklmnop") for _ in range(r.randrange(0, 14))]
        a = [w if r.random() < 0.8 else r.choice("abcxyz") for w in b if r.random() < 0.9] + [r.choice("abcd") for _ in range(r.randrange(3))]
        want = plain(a, b)
        found = align(a, b)
        assert all(a[i] == b[j] for i, j in found)
        if want is not None:
            assert found == want
            told += 1
    assert told > 200


def test_two_licenses_in_one_text(spark):
    names = ["MIT", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "MPL-2.0", "LGPL-2.1", "AGPL-3.0"]
    rows = [(i, f"Some code first.\n{TEMPLATES[a]}\n and then of the software {TEMPLATES[b]} the rest") for i, (a, b) in enumerate(zip(names, names[1:]))]
    got = {(r.doc_id, r.license): r.coverage for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i, a] == 1.0 for i, pair in enumerate(zip(names, names[1:])) for a in pair)
    # Of the others only those whose words a text really has in order.
    assert {k for k in got if k[1] not in names[k[0] : k[0] + 2]} <= {(0, "BSD-2-Clause"), (1, "BSD-2-Clause"), (6, "GPL-3.0"), (5, "GPL-3.0"), (5, "AGPL-3.0")}


def test_regions_hold_every_copy():
    r = random.Random(9)
    for _ in range(300):
        b = [r.choice("abcdefgh") for _ in range(r.randrange(2, 12))]
        a, starts = [], []
        for _ in range(r.randrange(1, 4)):
            a += [r.choice("abcdefghxyz") for _ in range(r.randrange(0, 8))]
            starts.append(len(a))
            a += b
        a += [r.choice("abcdefghxyz") for _ in range(r.randrange(0, 8))]
        found = regions(a, b, len(b))
        assert {(s, s + len(b)) for s in starts} <= set(found)
        assert all(len(align(a[s:e], b)) == len(b) for s, e in found if e - s == len(b))
        assert len(best_alignment(a, b, len(b))) == len(b)


def scripts(r):
    """Texts of six made-up languages: Latin, two Cyrillic ones, Greek, Arabic, and one of 1,500 signs."""
    ranges = {"la": range(97, 123), "cy": range(0x430, 0x450), "cz": range(0x430, 0x450), "gr": range(0x3B1, 0x3CA), "ar": range(0x627, 0x64A), "zh": range(0x4E00, 0x4E00 + 1500)}
    ranges = {k: [chr(c) for c in v if chr(c).isalpha() and chr(c) == chr(c).lower()] for k, v in ranges.items()}
    size = {k: 900 if k == "zh" else 150 for k in ranges}
    words = {k: ["".join(r.choice(v) for _ in range(2 if k == "zh" else r.randrange(3, 8))) for _ in range(size[k])] for k, v in ranges.items()}
    return words, lambda k, n: ("" if k == "zh" else " ").join(r.choice(words[k]) for _ in range(n))


def test_language_id_of_many_scripts(spark):
    r = random.Random(12)
    words, text = scripts(r)
    names = list(words)
    rows = [(i, text(names[i % 6] if i % 7 else "la", r.randrange(60, 120)), names[i % 6] if i % 7 else "la", "s", 1) for i in range(420)]
    rows += [(900, "".join(chr(0x10D0 + r.randrange(30)) for _ in range(200)), "la", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    said = {x.doc_id: (x.lang_pred, x.score) for x in language_id(df).collect()}
    test = [(i, k) for i, _, k, *_ in rows[:420] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {k for _, k in test} == set(names) and all(said[i][0] == k and said[i][1] > 0 for i, k in test)
    import corpus_pipeline

    kept = {x.doc_id for x in corpus_pipeline.keep_known_languages(spark, df, "").collect()}
    assert kept == set(range(420))  # not 900, whose letters no language has


def test_language_id_of_equal_costs_and_repeated_ids(spark):
    rows = [(i, "abc abd acd", "bb" if i % 3 else "aa", "s", 1) for i in range(40)] + [(3, "zzz yyy", "aa", "s", 1), (3, "abd", "aa", "s", 1)]
    parts = [language_id(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect() for n in (1, 5)]
    assert Counter(map(tuple, parts[0])) == Counter(map(tuple, parts[1]))  # the same model from any partitioning
    plain = language_id(spark.createDataFrame(rows[:40], SCHEMA), sample_symbols=23).collect()
    assert {x.lang_pred for x in plain} == {"bb"} and {x.score for x in plain} == {0.0}  # equal costs: the one with more rows


def test_many_languages_do_not_overflow():
    r = random.Random(1)
    train = [(f"l{k}", "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300))) for k in range(400)]
    parser = CrossParser(train)
    assert (parser.table >= 0).all() and parser.predict([train[k][1] for k in (0, 399)])[0] == ["l0", "l399"]


def test_cross_parsing_beyond_the_dense_table():
    r = random.Random(13)
    words, text = scripts(r)
    train = [(k, text(k, 60)) for k in words]
    parser = CrossParser(train)
    assert parser.beyond > 100
    texts = [text(k, n) for k in words for n in (3, 40)] + [f"{train[0][1][:99]} {train[5][1][:99]} \u10d0\u10d1 {train[1][1][:99]}", ""]
    total, _, _ = parser.phrases(texts)
    for k, (_, source) in enumerate(train):
        source = f" {source} "
        for i, t in enumerate(texts):
            s, count = f" {t} " if t else "  ", 0
            s = re.sub(" +", " ", s)
            for lo in range(0, len(s), 256):
                part, at = s[lo : lo + 256], 0
                while at < len(part):
                    n = 1
                    while at + n < len(part) and part[at : at + n + 1] in source:
                        n += 1
                    at, count = at + n, count + 1
            assert total[k, i] == count, (k, t)
