"""N-gram Jaccard join with a token-group matrix.

A text's set holds its distinct 3-word shingles (64-bit hashes, A-Z lowered). Texts with one set are one
class; classes link at Jaccard >= 0.9, and components of the links are returned. Any two linked sets
share at least k of their first tokens in hash order (``_prefix``), so only those tokens are indexed:

1. the first tokens of all sets are packed by hash range, as many ranges as the texts' bytes ask for; a token that only
   one class has is dropped there, together with those that no class of a fitting size shares. What shares a
   token within one slice of texts is known before that and goes past the ranges;
2. classes whose most common shared token is the same are similar, and form groups of at most GROUP classes and GROUP_TOKENS tokens; where
   it has more, those of like size and the same first shared token come together. Each group is opened by itself, and its
   links are joined to components. Where a key has several groups, one class for each component and key forms
   groups again, as long as that merges many: so the groups of a large cluster become one component without
   being compared with each other;
3. the matrix has a row (token, group) for the union of each group's tokens, with the ranges of its sizes and of its
   components' ranks. A query class meets a group in so many tokens of the union; if that count is below k, no
   member can link (the bound). Only groups that reach it, and that hold a component of a larger rank than the
   query's own, are opened: of two classes in different components the one of the smaller component asks;
4. an opened group gets the whole sets of its members and of its queries. Pairs that are connected already need
   no comparison; what leaves is a spanning forest of the links found.

Hot tokens: copies are one class before anything is paired, a cluster that has become one component
asks nothing, and queries of one group are dealt out in blocks. Nothing is capped. Sets are compared by the 64-bit
hashes of their tokens, classes by two such sums: exact but for collisions of hashes, which no word is looked at for.

Edge cases: null and empty texts have no shingle and link with nothing (each its own component); 1 or
2 words are one shingle. Rows with null doc_id are returned with null component_id. Rows with one doc_id
and different texts link as that doc_id. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm import textkit as K
from tidelex.llm.shared import bits_for, collect_shuffles, components, shuffle_partitions, small_batches, stored, text_bytes

SHINGLE = 3
NUMERATOR, DENOMINATOR = 9, 10
EXTRA = 8
GROUP = 1024
QUERIES = 1024
GROUP_TOKENS = 2 << 20
RANGE, TASK = 32 << 20, 64 << 20
LEAST_PASS = 256 << 20
ROUNDS = 5


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts, one after another, and the n+1 offsets."""
    data = K.lower_ascii(data)
    starts, ends, words = K.word_spans(data, offsets)
    h = K.word_hashes(data, starts, ends)
    win, at = K.windows_of_texts(h, words, size)
    counts = np.diff(words)
    owner = np.searchsorted(words, at, "right") - 1
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):  # the whole sequence as one shingle, with its length in it
        one = np.array([int(K.window_hashes(h[words[i] : words[i + 1]], int(counts[i]))[0]) ^ int(counts[i]) for i in short], np.uint64)
        win, owner = np.r_[win, K.mix(one)], np.r_[owner, short]
    order = np.lexsort((win, owner))
    win, owner = win[order], owner[order]
    new = np.ones(len(win), bool)
    new[1:] = (win[1:] != win[:-1]) | (owner[1:] != owner[:-1])
    win, owner = win[new], owner[new]
    return win, np.searchsorted(owner, np.arange(len(counts) + 1))


def least_overlap(n, num: int, den: int):
    """Tokens that a set of n shares at least with any it links to."""
    return -(-num * n // den)


def extra(n):
    """Shared first tokens asked for, by set size: more of them bound better and index more."""
    return np.maximum(1, n // EXTRA)


def _prefix(n, num: int, den: int):
    return n - least_overlap(n, num, den) + extra(n)


def _fingerprints(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set: order does not matter to a sum."""
    out = []
    for salt in (0x51ED270B0A1F39C5, 0xC2B2AE3D27D4EB4F):
        run = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(K.mix(sets ^ np.uint64(salt)), out=run[1:])
        out.append(K.mix(run[bounds[1:]] - run[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _each(batches, size: int):
    K.model("shingles", lambda: None)
    for batch in batches:
        for part in K.slices(batch, "text"):
            yield part, *shingle_sets(*K.text_buffers(part.column("text")), size)
    K.release()


def class_table(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, fa, fb): equal fingerprints for equal sets, null for empty ones."""

    def run(batches):
        for part, sets, bounds in _each(batches, size):
            n = np.diff(bounds)
            fa, fb = _fingerprints(sets, bounds)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(fa, mask=n == 0), pa.array(fb, mask=n == 0)], names=["doc_id", "n_shingles", "fa", "fb"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, fa long, fb long")


def _pack(batches, size: int, bits: int, num: int, den: int):
    """First tokens by hash range: tokens, fingerprint and size of their set. What shares a token within a slice is
    known to share it and goes by itself, at a negative range; for the others' sake the range gets the smallest and
    largest of those in each class of sizes that fit one another. So a hot token has few entries for each slice."""
    for part, sets, bounds in _each(batches, size):
        n = np.diff(bounds)
        fa, _ = _fingerprints(sets, bounds)
        _, once = np.unique(fa, return_index=True)
        once = once[n[once] > 0]
        many = np.minimum(n[once], _prefix(n[once], num, den))
        token, fa, n, fits = _fitting(sets[np.repeat(bounds[once], many) + K.ranges(many)], np.repeat(fa[once], many), np.repeat(n[once], many), num, den)
        if not len(token):
            continue
        sizes = np.floor(np.log(n) / np.log(den / num) * (1 + 1e-9)) if den > num else n
        first = _new(token) | _new(sizes) | _new(fits)
        sent = ~fits | first | np.r_[first[1:], True]
        key = (K.mix(token) >> np.uint64(64 - bits)).astype(np.int64)
        rows = _rows(key[sent], token[sent], fa[sent], n[sent])
        if fits.any():
            rows += _rows(np.full(int(fits.sum()), -1 - int(K.mix(token[:1])[0] >> np.uint64(44))), token[fits], fa[fits], n[fits])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 4)], names=["range", "tokens", "sets", "sizes", "counts"])


def _rows(key: np.ndarray, token: np.ndarray, fa: np.ndarray, n: np.ndarray) -> list[tuple]:
    """One row a key; a set's tokens stand together."""
    order = np.lexsort((fa, key))
    key, token, fa, n = key[order], token[order], fa[order], n[order]
    cuts = np.r_[np.flatnonzero(_new(key)), len(key)]
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        first = np.flatnonzero(_new(fa[a:b]))
        rows.append((int(key[a]), token[a:b].tobytes(), fa[a:b][first].tobytes(), K.planes(n[a:b][first], np.uint32), K.planes(np.diff(np.r_[first, b - a]), np.uint32)))
    return rows


def _new(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def _fitting(token: np.ndarray, fa: np.ndarray, n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, ...]:
    """Distinct (token, set, size) by token and size, and whether another set of a fitting size has the token."""
    order = np.lexsort((fa, n, token))
    token, fa, n = token[order], fa[order], n[order]
    once = _new(token) | _new(fa)
    token, fa, n = token[once], fa[once], n[once]
    fits = np.zeros(len(token), bool)  # sizes within a token ascend: the nearest neighbour decides
    if len(token) > 1:
        near = (token[1:] == token[:-1]) & (den * n[:-1] >= num * n[1:])
        fits[1:] |= near
        fits[:-1] |= near
    return token, fa, n, fits


def _shared(table: pa.Table, num: int, den: int) -> pa.Table:
    """Of one hash range: (token, set, size) of tokens that two sets of fitting sizes have. Rows of negative ranges do."""
    token, fa, n, known = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], False
    for batch in table.to_batches():
        for r in batch.to_pylist():
            c = K.from_planes(r["counts"], np.uint32)
            token.append(np.frombuffer(r["tokens"], np.uint64))
            fa.append(np.repeat(np.frombuffer(r["sets"], np.int64), c))
            n.append(np.repeat(K.from_planes(r["sizes"], np.uint32).astype(np.int64), c))
            known = r["range"] < 0
    token, fa, n, fits = _fitting(np.concatenate(token), np.concatenate(fa), np.concatenate(n), num, den)
    fits |= known
    K.release()
    return pa.table({"token": token[fits].view(np.int64), "fa": fa[fits], "n": n[fits]})


def _link_cell(left: list, right: list, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect whatever links between two lists of (class, set), which may be one list."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    right = sorted(right, key=lambda x: (len(x[1]), x[0]))
    sizes = np.array([len(x[1]) for x in right], np.int64)
    # All tokens of the right side as columns; a query counts its hits by member in one pass.
    tokens = np.concatenate([x[1] for x in right])
    member = np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, member = tokens[order], member[order]
    for a, mine in left:
        lo, hi = np.searchsorted(tokens, mine, "left"), np.searchsorted(tokens, mine, "right")
        hits = np.bincount(member[np.repeat(lo, hi - lo) + K.ranges(hi - lo)], minlength=len(right)) if len(mine) else np.zeros(len(right))
        union = len(mine) + sizes - hits
        for k in np.flatnonzero(den * hits >= num * union):
            b = right[k][0]
            if a != b and (x := find(a)) != (y := find(b)):
                root[max(x, y)] = min(x, y)
                out.append((a, b))
    return out


def _join(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A sort-merge join at every size: none of these sides has a bound."""
    return a.join(b.hint("merge"), on, how)


def _grouped(classes: DataFrame, group: int) -> DataFrame:
    """classes(rep, fa, n, key, weight) with ``gid``: at most ``group`` of one key and, but for a single set, GROUP_TOKENS
    tokens, those of large weight first. Keys of more classes are dealt out by a hash before they are sorted."""
    hot = classes.groupBy("key").count().where(F.col("count") > group).select("key", F.ceil(F.col("count") / group).alias("parts"))
    dealt = _join(classes, hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1))))

    def number(batches):
        was, turn, k, tokens = None, 0, 0, 0
        for batch in batches:
            places = []
            for *here, n in zip(*(batch.column(c).to_pylist() for c in ("key", "salt", "n"))):
                if here != was:
                    was, turn, k, tokens = here, 0, 0, 0
                elif k == group or tokens + n > GROUP_TOKENS:
                    turn, k, tokens = turn + 1, 0, 0
                k, tokens = k + 1, tokens + n
                places.append((here[0], here[1] * 1_000_003 + turn))
            keys, turns = (np.array(c, np.int64).view(np.uint64) for c in zip(*places)) if places else (np.zeros(0, np.uint64),) * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "fa", "n", "key")), pa.array(K.mix(keys ^ K.mix(turns + np.uint64(1))).view(np.int64))], names=["rep", "fa", "n", "key", "gid"])

    sorted_ = dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", F.desc("weight"), "n", "rep")
    return stored(sorted_.mapInArrow(number, "rep long, fa long, n long, key long, gid long"), "groups")


def _links_within(grouped: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links of each group's members, as a spanning forest."""
    shared = grouped.groupBy("gid").count().where("count > 1").select("gid")

    def link(table: pa.Table) -> pa.Table:
        mine = [(r["rep"], np.frombuffer(r["tokens"], np.uint64)) for r in table.to_pylist()]
        return _edges(_link_cell(mine, mine, num, den))

    rows = _join(_join(grouped, shared, "gid", "left_semi").select("gid", "rep", "fa"), sets, ["rep", "fa"]).select("gid", "rep", "tokens")
    return stored(rows.groupBy("gid").applyInArrow(link, "a long, b long"), "links")


def _edges(links: list) -> pa.Table:
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


def _band(n, num: int, den: int):
    """Sizes that fit one another lie in neighbouring bands."""
    return F.floor(F.log(n) * ((1 + 1e-9) / math.log(den / num))) if den > num else n.cast("long")


def _cells(grouped: DataFrame, postings: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, fa, n, gid): the groups that a class has to be compared with, of grouped(rep, fa, n, gid, rank)."""
    rows = stored(_join(postings, grouped, ["fa", "n"]).select("token", "rep", "fa", "n", "gid", "rank"), "rows")
    matrix = rows.groupBy("token", "gid").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rank").alias("top"))
    # A token whose classes are in one component asks nothing, nor do those of its largest component.
    top = rows.groupBy("token").agg(F.max("rank").alias("best"), F.min("rank").alias("least")).where("least < best").select("token", "best")
    asking = _join(rows, top, "token").where("rank < best").select("token", "rep", "fa", "n", "rank")
    fits = f"q.n * {num} <= g.high * {den} AND g.low * {num} <= q.n * {den} AND q.rank < g.top"
    met = _join(asking.alias("q"), matrix.alias("g"), "token").where(fits)
    smallest = F.greatest(F.least("n", "low"), F.ceil(F.col("n") * num / den))  # of the sets it may link to
    asked = F.greatest(F.lit(1), F.floor(smallest / EXTRA))
    cells = met.groupBy("rep", "fa", "n", "gid").agg(F.count("*").alias("met"), F.min("low").alias("low")).where(F.col("met") >= asked)
    return stored(cells.select("rep", "fa", "n", "gid"), "cells")


def _links_across(grouped: DataFrame, postings: DataFrame, sets: DataFrame, num: int, den: int, pass_bytes: int) -> DataFrame:
    """Links between components, of grouped(rep, fa, n, gid, rank): classes ask groups through the matrix, of each group
    the members of one band of sizes. Opened groups are dealt to as many passes as their sets have ``pass_bytes``."""
    grouped = grouped.withColumn("gid", F.xxhash64("gid", _band(F.col("n"), num, den)))
    cells = _cells(grouped, postings, num, den)
    collect_shuffles(cells.sparkSession)
    blocks = cells.groupBy("gid").agg(F.greatest(F.ceil(F.count("*") / QUERIES), F.ceil(F.sum("n") / GROUP_TOKENS)).cast("int").alias("blocks"), F.sum("n").alias("asking"))
    held = _join(grouped.groupBy("gid").agg(F.sum("n").alias("held")), blocks, "gid")
    amount = 8 * int(held.agg(F.sum(F.col("asking") + F.col("held") * F.col("blocks"))).first()[0] or 0)
    passes = max(1, -(-amount // pass_bytes))
    turn = F.pmod(F.xxhash64("gid", "block"), F.lit(passes))
    members = _join(grouped, blocks, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "fa", F.lit(1).alias("side"))
    queries = _join(cells, blocks, "gid").select("gid", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), "rep", "fa", F.lit(0).alias("side"))

    def link(table: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        for r in table.to_pylist():
            sides[r["side"]].append((r["rep"], np.frombuffer(r["tokens"], np.uint64)))
        return _edges(_link_cell(*sides, num, den) if sides[0] and sides[1] else [])

    links = None
    for i in range(passes):
        opened = _join(members.unionByName(queries).where(turn == i), sets, ["rep", "fa"]).select("gid", "block", "side", "rep", "tokens")
        found = stored(opened.groupBy("gid", "block").applyInArrow(link, "a long, b long"), "links")
        links = found if links is None else links.unionByName(found)
        collect_shuffles(cells.sparkSession)
    return links


def ngram_components(docs: DataFrame, size: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR, group: int = GROUP, range_bytes: int = RANGE, pass_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``docs(doc_id, text)``; sets link at Jaccard >= num/den."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    amount = text_bytes(docs)
    bits, tasks = bits_for(amount, range_bytes), max(shuffle_partitions(docs.sparkSession), -(-amount // TASK))
    members = stored(class_table(docs, size), "sets")
    packed = docs.where("doc_id IS NOT NULL").mapInArrow(lambda it: _pack(it, size, bits, num, den), "range int, tokens binary, sets binary, sizes binary, counts binary")
    shared = packed.repartition(tasks, "range").groupBy("range").applyInArrow(lambda t: _shared(t, num, den), "token long, fa long, n long")
    postings = stored(shared.distinct(), "postings")
    collect_shuffles(docs.sparkSession)

    # Classes that may link at all, each by its smallest doc_id, and their whole sets.
    classes = members.where("fa IS NOT NULL AND doc_id IS NOT NULL").groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"))
    fewest = F.floor(F.ceil(F.col("n") * num / den) / EXTRA)  # what the smallest set that fits asks for
    often = postings.groupBy("token").agg(F.count("*").alias("often"))
    owned = _join(postings, often, "token").groupBy("fa", "n").agg(F.max(F.struct("often", "token")).alias("common"), F.min("token").alias("first"), F.count("*").alias("met"))
    owned = stored(owned.where(F.col("met") >= F.greatest(F.lit(1), fewest)).select("fa", "n", F.col("common.token").alias("common"), "first"), "met")
    # A common token of many classes has several keys: by their size, as a line of many texts is in long and short ones, and then
    # by their first token, which similar classes share too.
    hot = owned.groupBy("common").count().where(F.col("count") > group).select("common", F.lit(True).alias("hot"))
    owned = _join(owned, hot, "common", "left").withColumn("band", F.when(F.col("hot"), _band(F.col("n"), num, den)).otherwise(-1))
    spread = owned.groupBy("common", "band").agg(F.ceil(F.count("*") / group).alias("keys"))
    owned = _join(owned, spread, ["common", "band"]).withColumn("key", F.xxhash64("common", "band", F.pmod(F.xxhash64("first"), "keys")))
    owned = stored(_join(owned, classes, "fa").select("rep", "fa", "n", "key").distinct(), "owned")

    def whole(batches):
        for part, sets, bounds in _each(batches, size):
            fa, _ = _fingerprints(sets, bounds)
            keep = [i for i, (a, b) in enumerate(zip(fa.tolist(), part.column("fa").to_pylist())) if a == b]  # a doc_id may have other texts
            yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(keep, pa.int64())), part.column("fa").take(pa.array(keep, pa.int64())), pa.array([sets[bounds[i] : bounds[i + 1]].tobytes() for i in keep], pa.binary())], names=["rep", "fa", "tokens"])

    texts = _join(docs.withColumnRenamed("doc_id", "rep"), owned.select("rep", "fa"), "rep").select("rep", "fa", "text")
    sets = stored(texts.mapInArrow(whole, "rep long, fa long, tokens binary").dropDuplicates(["rep", "fa"]), "tokens")
    collect_shuffles(docs.sparkSession)

    first = grouped = _grouped(owned.withColumn("weight", F.lit(1)), group)
    links, before = None, owned.count()
    for _ in range(ROUNDS):
        found = _links_within(grouped, sets, num, den)
        links = found if links is None else links.unionByName(found)
        label = components(links)
        collect_shuffles(docs.sparkSession)
        labelled = _join(first, label, first.rep == label.node, "left").select("rep", "fa", "n", "key", "gid", F.coalesce("component", "rep").alias("component"))
        leaders = labelled.groupBy("key", "component").agg(F.min_by(F.struct("rep", "fa", "n"), "rep").alias("r"), F.count("*").alias("weight"))
        several = leaders.groupBy("key").count().where("count > 1").select("key")
        leaders = stored(_join(leaders, several, "key", "left_semi").select("r.rep", "r.fa", "r.n", "key", "weight"), "leaders")
        n = leaders.count()
        if 2 * n > before or n == 0:
            break
        before, grouped = n, _grouped(leaders, group)
    sized = labelled.groupBy("component").agg(F.count("*").alias("many"))
    ranked = _join(labelled, sized, "component").select("rep", "fa", "n", "gid", F.struct("many", "component").alias("rank"))
    found = components(links.unionByName(_links_across(stored(ranked, "ranked"), postings, sets, num, den, max(LEAST_PASS, amount // 2) if pass_bytes is None else pass_bytes)))

    reps_of = _join(classes, found, classes.rep == found.node, "left").select("fa", "fb", F.coalesce("component", "rep").alias("component"))
    # A doc_id of several rows stands in several classes; its rows join through it.
    many = members.where("doc_id IS NOT NULL AND fa IS NOT NULL").join(reps_of, ["fa", "fb"]).select("doc_id", "component")
    twice = many.groupBy("doc_id").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("doc_id")
    again = stored(many.join(twice, "doc_id").select("doc_id", "component").distinct(), "again")
    if not again.isEmpty():
        low = again.groupBy("doc_id").agg(F.min("component").alias("low"))
        merged = components(again.join(low, "doc_id").select(F.col("component").alias("a"), F.col("low").alias("b")))
        reps_of = reps_of.join(merged, reps_of.component == merged.node, "left").select("fa", "fb", F.coalesce(merged.component, reps_of.component).alias("component"))
    return _join(members, reps_of, ["fa", "fb"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
