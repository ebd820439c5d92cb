"""Near-duplicate documents by Order MinHash and banded alignment.

A document is the sequence of its five-word shingles, each labelled with how often it has occurred so
far, so that every labelled shingle is there once. A sketch takes the ``SIZE`` labelled shingles of
smallest hash and keeps them in text order; documents that agree in one of ``SKETCHES`` sketches are
candidates, which favours shared order and so edit similarity. Candidates are verified by aligning the
same labelled sequences: matches must rise in both texts and stay inside the band of offsets that a
similarity of ``THRESHOLD`` allows; the similarity is matches / (shingles of both - matches).

Sketch and alignment see the same shingles, repeats included: a line written once more adds its
shingles, and a text and the same text written twice are half alike. A pair of similarity 0.8 agrees
in a sketch with probability 0.41 if its texts are long and in no sketch with 5e-8; the worst case,
texts of five shingles and four, is missed with 8e-4.

Groups of any size are handled without listing their pairs: equal word sequences become one node
first; in each sketch bucket every node is aligned with the bucket's smallest node; links give
components. Only buckets that still hold several components are gone through once more, by blocks
of at most ``BLOCK`` nodes against each other: a pair of different components is compared in the
first bucket it shares, and of the links found a block returns a spanning forest. Classes are the
connected components of all verified links.

Defined results: texts with equal words are one class, texts without words (null, empty) too. A
text of fewer than five words has one shingle, its whole. A class is named after its smallest
doc_id (a null id is larger than all), and that row stays; of rows that repeat that id and text
one stays. One row per row; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_long, cut, discard, keep_rows, keyed, mix, slices, span_hash, without_others
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
#: Labelled shingles per sketch, and sketches per document.
SIZE = 4
SKETCHES = 32
#: A block holds about so many documents of a bucket, and shingles, whichever is reached first.
BLOCK = 512
BLOCK_SHINGLES = 1 << 22

with np.errstate(over="ignore"):
    _MULTIPLIERS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Shingles:
    """Hashes of the labelled shingles of a slice of texts in text order: ``wide`` in 64 bits,
    ``short`` the same in 32, and ``cuts``, the bounds of each text."""

    def __init__(self, column: pa.Array):
        self.words = Words(column)
        hashes, first = self.words.hashes(), self.words.first
        counts = np.diff(first)
        n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
        self.cuts = cuts = np.concatenate([[0], np.cumsum(n)])
        owner = np.repeat(np.arange(len(n)), n)
        start = np.arange(cuts[-1]) - cuts[owner] + first[owner]
        end = np.minimum(start + SHINGLE, first[owner + 1])
        plain = span_hash(hashes, start, end, 0)
        by = np.lexsort((plain, owner))  # stable: equal shingles of a text stay in text order
        new = np.ones(len(by), bool)
        new[1:] = (plain[by][1:] != plain[by][:-1]) | (owner[by][1:] != owner[by][:-1])
        group = np.flatnonzero(new)
        label = np.empty(len(by), np.uint64)
        label[by] = np.arange(len(by)) - np.repeat(group, np.diff(np.append(group, len(by))))
        with np.errstate(over="ignore"):
            self.wide = mix(plain + label * np.uint64(0xD6E8FEB86659FD93))
        self.short = (self.wide >> np.uint64(32)).astype(np.uint32)
        self.h1, self.h2 = (span_hash(hashes, first[:-1], first[1:], r) for r in (1, 2))


def sketch(wide: np.ndarray) -> np.ndarray:
    """The Order MinHash sketches of one text; 0 for a text without shingles."""
    n = len(wide)
    out = np.zeros(SKETCHES, np.uint64)
    step = max(1, (1 << 18) // max(1, n))
    for at in range(0, SKETCHES if n else 0, step):
        m = _MULTIPLIERS[at : at + step, None]
        with np.errstate(over="ignore"):
            if n > SIZE:
                least = np.sort(np.argpartition(wide[None, :] * m, SIZE - 1, axis=1)[:, :SIZE], axis=1)
            else:
                least = np.broadcast_to(np.arange(n), (len(m), n))
            total = m[:, 0].copy()
            for k in range(least.shape[1]):
                total = mix(total * np.uint64(31) + wide[least[:, k]])
        out[at : at + len(m)] = total | np.uint64(1)
    return out


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Similarity of two sequences of labelled shingles by banded alignment; 0 where surely below ``threshold``."""
    n = len(a) + len(b)
    need = threshold / (1 + threshold) * n
    _, i, j = np.intersect1d(a, b, return_indices=True)
    if len(i) < need - 1e-9:
        return 0.0
    band = n - 2 * need + 1
    near = np.abs(i - j) <= band
    j = j[near][np.argsort(i[near], kind="stable")]
    if len(j) and not (j[1:] > j[:-1]).all():
        ends: list[int] = []
        for x in j.tolist():
            at = bisect_left(ends, x)
            ends[at : at + 1] = [x]
        return len(ends) / (n - len(ends))
    return len(j) / max(1, n - len(j))


def sketches(docs: DataFrame) -> DataFrame:
    """One row per document: id, th, n (shingles), h1, h2 (hash of all words), sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s = Shingles(part.column(2))
            each = [sketch(s.wide[a:b]) for a, b in zip(s.cuts, s.cuts[1:])]
            flat = as_long(np.concatenate(each))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1, dtype=np.int32) * SKETCHES), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.diff(s.cuts)), pa.array(as_long(s.h1)), pa.array(as_long(s.h2)), lists], ["id", "th", "n", "h1", "h2", "sketches"]
            )

    return keyed(docs).mapInArrow(run, "id long, th long, n long, h1 long, h2 long, sketches array<long>")


def _shingles_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, grams (labelled shingles, 4 bytes each) of the rows of ``wanted`` (node, id, th)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s = Shingles(part.column(2))
            raw = s.short.tobytes()
            cuts = (4 * s.cuts).tolist()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())], ["id", "th", "grams"])

    texts = without_others(keyed(docs).withColumn("h", F.xxhash64("id", "th")), wanted.select(F.xxhash64("id", "th").alias("h")))
    found = texts.drop("h").mapInArrow(run, "id long, th long, grams binary")
    return cut(found.join(wanted, ["id", "th"]).select("node", "grams").dropDuplicates(["node"]), "near-shingles")


def _verified(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """The pairs (a, b) whose alignment reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= THRESHOLD - 1e-9
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    a = grams.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    b = grams.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y")
    return cut(both.mapInArrow(run, "a long, b long"), "near-links")


def _similar_length(n: str, m: str):
    """True unless the numbers of shingles rule out the threshold."""
    return F.least(n, m) >= F.lit(THRESHOLD) * F.greatest(n, m) - 1e-9


def _compare(key, table):
    """Links between two blocks of one bucket (or within one), as a spanning forest: columns a, b."""
    table = table.combine_chunks()
    bucket, kind = key[0].as_py(), key[1].as_py()
    node, label, side, n = (table.column(c).to_numpy() for c in ("node", "label", "side", "n"))
    lists = table.column("sketches").combine_chunks()
    own = lists.flatten().to_numpy().reshape(len(node), SKETCHES)
    place = int(np.argmax(own[0] == bucket))
    wanted = np.triu(label[:, None] != label[None, :], 1)
    wanted &= np.minimum(n[:, None], n[None, :]) >= THRESHOLD * np.maximum(n[:, None], n[None, :]) - 1e-9
    if kind != "within":
        wanted &= side[:, None] != side[None, :]
    for k in range(place):  # a pair is compared in the first bucket it shares
        wanted &= (own[:, None, k] != own[None, :, k]) | (own[:, None, k] == 0)
    i, j = np.nonzero(wanted)
    out = []
    if len(i):
        grams = [np.frombuffer(x, np.uint32) for x in table.column("grams").to_pylist()]
        if len(i) * n.mean() * 4 > len(n) ** 2 * min(64.0, n.mean()):
            shared = _overlaps(grams)[i, j]
            enough = shared >= THRESHOLD / (1 + THRESHOLD) * (n[i] + n[j]) - 1e-9
            i, j = i[enough], j[enough]
        root = {x: x for x in label.tolist()}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for x, y in zip(i.tolist(), j.tolist()):
            p, q = find(label[x]), find(label[y])
            if p != q and similarity(grams[x], grams[y]) >= THRESHOLD - 1e-9:
                root[max(p, q)] = min(p, q)
                out.append((node[x], node[y]))
    found = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": found[:, 0], "b": found[:, 1]})


def _overlaps(grams: list[np.ndarray]) -> np.ndarray:
    """How many shingles each pair of texts shares (an upper bound where one repeats in a text)."""
    owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    value, at, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    use = times[at] > 1  # shingles of one text alone are shared by no pair
    _, at = np.unique(at[use], return_inverse=True)
    owner = owner[use]
    total = np.zeros((len(grams), len(grams)), np.float32)
    by = np.argsort(at, kind="stable")
    at, owner = at[by], owner[by]
    width = 8192
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, [low, low + width])
        part = np.zeros((len(grams), width), np.float32)
        part[owner[a:b], at[a:b] - low] = 1
        total += part @ part.T
    return total


def _across(placed: DataFrame, every: DataFrame, grams: DataFrame) -> DataFrame:
    """Links between different components inside one bucket; ``placed``: v, node, n, head, label."""
    main = F.min(F.when(F.col("node") == F.col("head"), F.col("label"))).alias("main")
    others = F.when(F.col("node") != F.col("head"), F.col("label"))  # the head has met them all
    mixed = placed.groupBy("v").agg(F.min(others).alias("low"), F.max(others).alias("high"), main)
    mixed = cut(mixed.filter("low <> high").select("v", "main"), "near-mixed")
    rest = placed.filter("node <> head").join(mixed, "v")
    rest = cut(rest.select("v", "node", "n", "label", (F.col("label") != F.col("main")).alias("odd")), "near-rest")

    def blocks(which):
        count, shingles = F.count(F.when(which, 1)), F.sum(F.when(which, F.col("n")).otherwise(0))
        return F.greatest(F.ceil(count / F.lit(BLOCK)), F.when(count > 0, F.ceil(shingles / F.lit(BLOCK_SHINGLES))).otherwise(0)).cast("int")

    odds = cut(rest.groupBy("v").agg(blocks(F.col("odd")).alias("odds"), blocks(~F.col("odd")).alias("mains")), "near-odds")
    # Nodes of the head's component meet only the others; those meet everything.
    dealt = rest.join(odds.filter("odds > 0"), "v")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("odd"), F.col("odds")).otherwise(F.col("mains"))).cast("int"))

    def upto(c):
        return F.sequence(F.lit(0), F.col(c) - 1)

    def meeting(kind, x, y):
        return F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))

    block = F.col("block")
    among = F.transform(upto("odds"), lambda x: F.when(x == block, meeting("within", x, x)).otherwise(meeting("between", F.least(x, block), F.greatest(x, block))))
    with_main = F.when(F.col("mains") > 0, F.transform(upto("mains"), lambda x: meeting("main", block, x))).otherwise(F.array().cast("array<struct<kind:string,x:int,y:int>>"))
    of_main = F.transform(upto("odds"), lambda x: meeting("main", x, block))
    dealt = dealt.withColumn("m", F.explode(F.when(F.col("odd"), F.concat(among, with_main)).otherwise(of_main)))
    side = F.when(F.col("m.kind") == "main", F.col("odd").cast("int")).otherwise((block == F.col("m.x")).cast("int"))
    dealt = dealt.select("v", F.col("m.kind").alias("kind"), F.col("m.x").alias("x"), F.col("m.y").alias("y"), side.alias("side"), "node", "n", "label")
    held = every.select(F.col("rid").alias("node"), "sketches").join(rest.select("node").distinct(), "node").join(grams, "node")
    held = cut(held, "near-held")
    full = dealt.join(held, "node")
    links = cut(full.groupBy("v", "kind", "x", "y").applyInArrow(_compare, "a long, b long").distinct(), "near-across")
    discard(mixed, rest, odds, held)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: id, th, cluster_id, cluster_size, kept."""
    every = cut(sketches(docs).withColumn("rid", F.monotonically_increasing_id()), "near-sketches")
    groups = every.groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "rid")).alias("best"), F.count("*").alias("rows"))
    groups = cut(groups.select("h1", "h2", "n", F.col("best.id").alias("id"), F.col("best.rid").alias("node"), "rows"), "near-nodes")
    firsts = every.join(groups.select(F.col("node").alias("rid")), "rid", "left_semi")
    buckets = firsts.select(F.col("rid").alias("node"), "n", F.explode("sketches").alias("v")).filter("v <> 0")
    heads = buckets.groupBy("v").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("size")).filter("size > 1")
    heads = cut(heads.select("v", F.col("head.node").alias("head"), F.col("head.n").alias("head_n")), "near-heads")
    members = cut(buckets.join(heads, "v"), "near-members")

    stars = members.filter((F.col("node") != F.col("head")) & _similar_length("n", "head_n")).select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    wanted = cut(every.join(members.select("node").distinct(), every["rid"] == F.col("node")).select("node", "id", "th"), "near-wanted")
    grams = _shingles_of(docs, wanted)
    stars = cut(stars, "near-stars")
    links = _verified(stars, grams)
    discard(stars, wanted)
    labels = components(links)

    placed = members.join(labels, "node", "left").select("v", "node", "n", "head", F.coalesce("label", "node").alias("label"))
    placed = cut(placed, "near-placed")
    more = _across(placed, every, grams)
    if not more.isEmpty():
        labels = components(links.union(more))
    discard(placed, members, heads, grams, links, more)

    named = groups.join(labels, "node", "left").select("h1", "h2", "n", "id", "node", "rows", F.coalesce("label", "node").alias("label"))
    named = cut(named, "near-named")
    classes = cut(named.groupBy("label").agg(F.min(F.struct("id", "node")).alias("best"), F.sum("rows").alias("cluster_size")), "near-classes")
    classed = cut(named.join(classes, "label").select("h1", "h2", "n", "best", "cluster_size"), "near-classed")
    discard(labels, groups, named, classes)
    rows = every.select("id", "th", "rid", "h1", "h2", "n").join(classed, ["h1", "h2", "n"])
    return rows.select("id", "th", F.col("best.id").alias("cluster_id"), "cluster_size", (F.col("rid") == F.col("best.node")).alias("kept"))


def unique_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with the columns of ``docs``."""
    return keep_rows(docs, near_duplicates(docs).select("id", "th", "kept"))
