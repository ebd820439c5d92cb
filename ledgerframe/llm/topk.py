"""Exact top-k search by inner product: one KD-tree per shard, searched best box first.

Vectors are dealt into shards by a hash of their id; each shard's tree splits the widest side of a
box at the median down to small leaves and keeps the tight box of every node. A box bounds the
inner product with a query from above (each side gives the larger of its two end products). The
search of a tree starts at its root: the open node of the largest bound is taken next, an inner one
is replaced by its children, a leaf's vectors are scored, and the search ends when the largest open
bound falls below the query's kth score; subtrees below it are never looked at. All queries of a block
take such a step at once. The kth score starts from the query block compared with itself, by tasks
that share its rows, and travels from tree to tree of a task. Queries come in blocks of bounded size,
one pass over the index each.

Defined results: rows without id, null vectors and vectors holding null or non-finite components
take no part. Vectors are compared only with vectors of their own length (a zero-length one scores
0 against its like). A row repeated with id and vector counts once; if one query id comes with
several vectors, the smallest in component order is the query. Rows with the query's id are never
its candidates. Ties go to the smaller id. An empty table gives an empty result. Columns besides
the id and the vector are not read. Products must fit 64 bits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

SHARD_ROWS = 2048
LEAF_ROWS = 64
#: Queries that are collected and broadcast at once (8 MB at 64 components).
BLOCK_QUERIES = 8192
LOWEST = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, dim, v array<long>: floor(scale * x) of the usable vectors."""
    v = F.col(vector_col)
    usable = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.size(v).alias("dim"), whole.alias("v"))


def build(ids: np.ndarray, v: np.ndarray) -> dict:
    """A KD-tree as arrays: rows in leaf order; of each node its tight box, children (-1 for a leaf) and rows (of a leaf).

    The root is node 0. A box of equal vectors can't be split by a side; its rows are halved by id.
    """
    lo, hi, children, span, order, done = [], [], [], [], [], 0
    todo = [(np.arange(len(ids)), -1, 0)]
    while todo:
        rows, parent, which = todo.pop()
        node = len(lo)
        if parent >= 0:
            children[parent][which] = node
        lo.append(v[rows].min(axis=0))
        hi.append(v[rows].max(axis=0))
        children.append([-1, -1])
        span.append((0, 0))
        if len(rows) <= LEAF_ROWS:
            rows = rows[np.argsort(ids[rows], kind="stable")]
            order.append(rows)
            span[node] = (done, done + len(rows))
            done += len(rows)
            continue
        half = len(rows) // 2
        side = int(np.argmax(hi[node] - lo[node])) if v.shape[1] else -1
        by = np.argpartition(v[rows, side], half) if side >= 0 and hi[node][side] > lo[node][side] else np.argsort(ids[rows], kind="stable")
        todo += [(rows[by[half:]], node, 1), (rows[by[:half]], node, 0)]
    perm = np.concatenate(order)
    return {"ids": ids[perm], "v": v[perm], "lo": np.array(lo), "hi": np.array(hi), "children": np.array(children), "span": np.array(span)}


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers, by way of doubles where those are exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Best:
    """The k best candidates so far of each query of a block."""

    def __init__(self, query_ids: np.ndarray, k: int, floor: np.ndarray):
        self.query_ids, self.k = query_ids, k
        self.scores = np.full((len(query_ids), k), LOWEST, np.int64)
        self.ids = np.full((len(query_ids), k), np.iinfo(np.int64).max, np.int64)
        self.floor = floor

    def kth(self, rows) -> np.ndarray:
        return np.maximum(self.scores[rows, -1], self.floor[rows])

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where(ids[None, :] == self.query_ids[rows][:, None], LOWEST, scores)
        s = np.concatenate([self.scores[rows], scores], axis=1)
        i = np.concatenate([self.ids[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        i = np.where(s == LOWEST, np.iinfo(np.int64).max, i)
        by = np.lexsort((i, ~s), axis=-1)[:, : self.k]  # ~s falls as s rises and can't overflow
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)


def search(tree: dict, q: np.ndarray, best: Best) -> int:
    """Best-first from the root of one tree for all queries, one node a query a step; how many nodes were opened."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    children, span = tree["children"], tree["span"]

    def bounds(rows, node):
        return (products(up[rows], tree["hi"][node : node + 1]) + products(down[rows], tree["lo"][node : node + 1]))[:, 0]

    alive, opened = np.arange(len(q)), 0
    queue = np.full((len(q), len(children)), LOWEST, np.int64)  # the bounds of each query's open nodes
    queue[:, 0] = bounds(alive, 0)
    while len(alive):
        node = queue[alive].argmax(axis=1)
        top = queue[alive, node]
        going = (top > LOWEST) & (top >= best.kth(alive))
        alive, node = alive[going], node[going]
        queue[alive, node] = LOWEST
        opened += len(alive)
        for one in np.unique(node):
            rows = alive[node == one]
            if children[one, 0] >= 0:
                for child in children[one]:
                    bound = bounds(rows, child)
                    queue[rows, child] = np.where(bound >= best.kth(rows), bound, LOWEST)  # what can't reach the kth score is cut off
            else:
                a, b = span[one]
                best.offer(rows, products(q[rows], tree["v"][a:b]), tree["ids"][a:b])
    return opened


def index(vectors: DataFrame) -> DataFrame:
    """One row per shard: dim, shard, tree (pickled arrays); written to the shared folder."""
    n = vectors.count()
    shards = max(1, -(-n // SHARD_ROWS))

    def make(key, pdf):
        ids, v = pdf["id"].to_numpy(np.int64), np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), int(key[0]))
        both = np.unique(np.column_stack([ids, v]), axis=0)  # repeated rows count once
        tree = build(both[:, 0].copy(), both[:, 1:].copy())
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [pickle.dumps(tree, 5)]})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return cut(dealt.groupBy("dim", "shard").applyInPandas(make, "dim int, shard int, tree binary"), "topk-index")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, id, score of each query's k best other rows; ``vectors`` as from ``quantised``."""
    stored = cut(vectors, "topk-vectors")
    trees = index(stored)
    queries = stored.filter(is_query)
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    parts = max(1, min(trees.count(), 2 * vectors.sparkSession.sparkContext.defaultParallelism))
    trees = trees.repartition(parts, "dim", "shard")
    found = None
    for block in range(blocks):
        mine = queries.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)) == block)
        part = _search_block(trees, mine, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _search_block(trees: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Candidates of one bounded block of queries: at most k per query and task."""
    by_dim: dict[int, dict[int, list[int]]] = {}
    for row in queries.groupBy("id", "dim").agg(F.min("v").alias("v")).collect():
        by_dim.setdefault(row["dim"], {})[row["id"]] = row["v"]
    owner: dict[int, int] = {}
    for dim in sorted(by_dim):
        for i in by_dim[dim]:
            owner.setdefault(i, dim)
    block = {}
    for dim, rows in by_dim.items():
        ids = np.array(sorted(i for i in rows if owner[i] == dim), np.int64)
        v = np.array([rows[i] for i in ids.tolist()], np.int64).reshape(len(ids), dim)
        block[dim] = (ids, v)
    context = queries.sparkSession.sparkContext
    shared = context.broadcast(block)
    first = context.broadcast(_first_scores(queries, shared, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: Best(ids, k, np.array([first.value.get(i, LOWEST) for i in ids.tolist()], np.int64)) for dim, (ids, _) in shared.value.items()}
        for batch in batches:
            for dim, blob in zip(batch.column(0).to_pylist(), batch.column(2)):
                if dim in best:
                    search(pickle.loads(blob.as_py()), shared.value[dim][1], best[dim])
        for b in best.values():
            row, at = np.nonzero((b.scores > LOWEST) & (b.scores >= b.floor[:, None]))
            yield pa.RecordBatch.from_pydict({"query_id": b.query_ids[row], "id": b.ids[row, at], "score": b.scores[row, at]})

    return trees.mapInArrow(run, "query_id long, id long, score long")


def _first_scores(queries: DataFrame, shared, k: int) -> dict[int, int]:
    """A first kth score of each query of a block from the block itself; the block's parts are dealt to tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(batch.num_rows):
                dim, at, to = (batch.column(c)[part].as_py() for c in range(3))
                ids, v = shared.value[dim]
                mine, seed = np.arange(to - at), Best(ids[at:to], k, np.full(to - at, LOWEST, np.int64))
                for c in range(0, len(ids), 512):
                    seed.offer(mine, products(v[at:to], v[c : c + 512]), ids[c : c + 512])
                yield pa.RecordBatch.from_pydict({"id": ids[at:to], "kth": seed.scores[:, -1]})

    parts = [(dim, at, min(len(ids), at + 512)) for dim, (ids, _) in shared.value.items() if len(ids) > k for at in range(0, len(ids), 512)]
    if not parts:
        return {}
    spark = queries.sparkSession
    dealt = spark.createDataFrame(parts, "dim int, low int, high int").repartition(min(len(parts), 2 * spark.sparkContext.defaultParallelism))
    return {r["id"]: r["kth"] for r in dealt.mapInArrow(run, "id long, kth long").collect()}
