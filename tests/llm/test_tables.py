import gzip
import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelex.llm import lattice_dedup as L
from tidelex.llm.shared import components
from tidelex.llm.warc import ARC_FIELDS, ArcRecord, convert, page_of, read_arc, read_back, read_warc, record_id, to_warc, unpacked, warc_round_trip, write_arc


@pytest.mark.parametrize("in_task", [300_000, 40])
def test_components(spark, in_task):
    r = random.Random(0)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1080)] + [(2000, i) for i in range(2001, 2100)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), in_task=in_task).collect()}
    assert got == {x: find(x) for x in list(up)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, (200, 8))
    p = L.decode_e8(x) / 2
    assert ((np.rint(p * 2) == p * 2).all()) and (p.sum(1) % 2 == 0).all()
    d = ((x - p) ** 2).sum(1)
    for r in L.roots() / 2:  # no neighbour is nearer
        assert (((x - p - r) ** 2).sum(1) >= d - 1e-9).all()
    assert len(L.roots()) == 240


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((120, 64))
    rows, k = [], 0
    for v in base:
        for noise in (0, 0, 0.2, 0.3, 0.38):
            rows.append((k, (v + noise * rng.standard_normal(64)).astype(np.float32).tolist(), int(k % 3 == 0)))
            k += 1
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63, [float("inf")] + [1.0] * 63, [1.0] * 8]
    rows += [(k + i, v, 1) for i, v in enumerate(bad)] + [(k + 20, rows[0][1], None), (None, rows[0][1], 0), (k + 30, [1e-30 * x for x in rows[0][1]], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cid", F.lit("clash"))
    good = {}
    for i, v, label in rows:
        x = None if v is None or len(v) != 64 or None in v else np.array(np.array(v, np.float32), np.float64)
        if i is not None and label is not None and x is not None and np.isfinite(x).all() and x.any():
            good[i] = (label, x / np.linalg.norm(x / np.abs(x).max()) / np.abs(x).max())
    up, links = {i: i for i, *_ in rows if i is not None}, Counter()

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in good.items():
        for j, (b, y) in good.items():
            if i < j and a == b and x @ y >= 0.93:
                links[i] += 1
                links[j] += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.vec_id: r for r in L.embedding_components(df).collect()}
    assert len(got) == len(rows) and got[None].component_id is None and got[None].n_links == 0
    wrong = [i for i in up if (got[i].n_links, got[i].component_id, got[i].kept) != (links[i], find(i), find(i) == i)]
    assert len(wrong) <= 0.02 * len(up) and sum(links.values()) > 300  # a probe may miss a link; none is made up
    assert all(got[i].n_links <= links[i] for i in up) and sum(got[i].n_links for i in up) >= 0.98 * sum(links.values())  # recall of links
    assert L.embedding_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_to_warc(version):
    records = [ArcRecord("http://a/x y", "1.2.3.4", "20010203040506", "text/html", "200", b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nab\n"), ArcRecord("http://b/", "0.0.0.0", "19991231235959", "image/gif", "404", b"\n\nGIF"), ArcRecord("dns:a", "0.0.0.0", "19991231235959", "text/dns", None, b"")]
    got = list(read_arc(write_arc(records, version)))
    assert [(r.url, r.date, r.mime, r.block) for r in got] == [(r.url.replace(" ", "%20"), r.date, r.mime, r.block) for r in records]
    assert got[0].status == ("200" if version == 2 else None) and got[0].split() == (records[0].block[:-3], b"ab\n")
    warc = b"".join(to_warc(r, k, 7 if k == 0 else None) for k, r in enumerate(got))
    heads = list(read_warc(warc))
    assert [h["warc-type"] for h, _ in heads] == ["revisit", "response", "response"] and heads[0][0]["warc-date"] == "2001-02-03T04:05:06Z"
    assert page_of(heads[0][0]["warc-refers-to"]) == 7 and heads[1][1] == b"\n\nGIF"
    for broken in (write_arc(records, version)[:-3], b"http://x 0 0 text/html 4\nabcd\n", write_arc(records, version).replace(ARC_FIELDS[version].encode(), b"", 1)):
        with pytest.raises(ValueError):
            list(read_arc(broken))


def test_record_ids_hold_numbers():
    for n in (0, 1, 2**62, 2**63 - 1, -1, -(2**63), None):
        assert page_of(record_id(n)) == n


@pytest.mark.parametrize("heavy, file_bytes", [(100_000, 32 << 20), (2, 3000)])
def test_warc_round_trip(spark, heavy, file_bytes):
    big, small, other = "<p>é" * 400, "<p>same", "<q>b" * 300
    rows = [(1, "http://a", big), (2, "http://b", big), (9, "u r l", big), (3, None, small), (4, "http://c", small), (5, "x", None), (6, "x", ""), (7, "x", "\r\n\r\nWARC/1.1\r\n"), (None, "n", big), (9, "u r l", big), (8, "l", "z" * 300_000)]
    rows += [(20, "two", other), (20, "two", big + "!"), (21, "t", big + "!"), (22, "t", other), (20, "two", big)]  # one page_id, several payloads
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash")).withColumn("digest", F.lit(1))
    got = Counter(tuple(r) for r in warc_round_trip(pages, heavy=heavy, file_bytes=file_bytes).collect())
    want = Counter()
    for i, _, t in rows:
        b = (t or "").encode()
        same = [j for j, _, u in rows if j is not None and u == t] if len(b) >= 1000 else []
        to = max(same) if i is not None and same and max(same) > i else None
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to] += 1
    assert got == want
    assert warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archives_of_others(spark, tmp_path):
    """ARC without page numbers and with payloads that are no text; WARC with a gzip member a record."""
    binary = bytes(range(256)) * 5
    records = [ArcRecord("http://a/", "1.2.3.4", "200102030405", "text/html", "200", b"HTTP/1.0 200 OK\r\n\r\n" + binary), ArcRecord("http://b/", "0.0.0.0", "19991231235959", "image/gif", "404", binary), ArcRecord("dns:a", "0.0.0.0", "19991231235959", "text/dns", None, b"")]
    arcs = spark.createDataFrame([(write_arc(records, 1),), (write_arc(records[:1], 2),)], "arc binary").coalesce(1)
    for size, files in ((32 << 20, 1), (2000, 3)):
        folder = convert(arcs, str(tmp_path / f"w{size}"), size)
        paths = [x for x in os.listdir(folder) if x.endswith(".gz")]
        assert len(paths) == files
        whole = [list(read_warc(gzip.open(f"{folder}/{x}").read())) for x in paths]
        assert all(w[0][0]["warc-type"] == "warcinfo" for w in whole)
        found = [(h, b) for w in whole for h, b in w[1:]]
        assert sorted(b for _, b in found) == sorted([records[0].block, *(r.block for r in records)])
        assert len({h["warc-record-id"] for h, _ in found}) == 3 and all(page_of(h["warc-record-id"]) is None for h, _ in found)
        got = Counter(tuple(r) for r in read_back(arcs, folder).collect())
        digest = hashlib.sha1(binary).hexdigest()
        assert got == {(None, len(binary), digest, "response", None): 3, (None, 0, hashlib.sha1(b"").hexdigest(), "response", None): 1}
    members = tmp_path / "members"
    members.mkdir()
    (members / "x.warc.gz").write_bytes(b"".join(gzip.compress(to_warc(r, k)) for k, r in enumerate(records)))
    assert sorted((r.page_id, r.payload_bytes) for r in read_back(arcs, str(members)).collect()) == [(0, 1280), (1, 1280), (2, 0)]
    data = b"".join(gzip.compress(to_warc(r, k)) for k, r in enumerate(records))
    assert [h for h, _ in read_warc(unpacked(data, 7))] == [h for h, _ in read_warc(gzip.decompress(data))]
    for broken in (data[:-9], gzip.compress(to_warc(records[0], 1)[:-2])):
        with pytest.raises(ValueError):
            list(read_warc(unpacked(broken)))
