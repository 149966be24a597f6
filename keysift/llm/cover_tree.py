"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data are both indexed by cover trees: a node has one of its own points as
centre and a radius that covers all points below it, and its children cover it with
balls of half that radius.  Two nodes are compared by the largest inner product that
any pair below them can have,

    q.d <= qc.dc + |qc| * Rd + |dc| * Rq + Rq * Rd,

and are dropped together when even that is below the worst kth score among the queries
of the query node.  Vectors are integers, so scores and ties are exact:
products of floats where these hold every partial sum, and of 64-bit integers elsewhere.

Queries come in blocks of about ``QUERY_BLOCK`` rows and data in blocks of at most
``DATA_BLOCK``.  Tasks build a tree over each block and write it to the shared folder;
only the names of the files pass through Spark.  Every tree of queries then meets every
file of data trees in some task, which holds one of the former and one tree of the
latter at a time and keeps ``k`` rows per query.  These meet per query in a window that
Spark limits before its shuffle.  The driver sees no vector and one count.

Defined cases.  Vectors that are null or hold null, NaN or infinity take no part.
Vectors meet only vectors of their own length; empty vectors score 0 with each other.
A query's own id is no candidate for it, also where that id is repeated; rows repeated
under another id are candidates each.  Equal query rows are one query; rows with one id
and several vectors are several queries.  Fewer candidates than k give fewer rows.
Scores outside 64 bits, and -2^63, are not defined.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysift.llm.files import new_file, open_file
from keysift.plans.durable import materialise, scratch_dir

QUERY_BLOCK = 8192
DATA_BLOCK = 4096
LEAF = 48
_NONE = np.iinfo(np.int64).min
# Floats hold all integers up to here.
_EXACT = float(1 << 53)


class Node:
    __slots__ = ("points", "centre", "norm", "radius", "children")

    def __init__(self, points, centre, norm, radius, children):
        self.points, self.centre, self.norm, self.radius, self.children = points, centre, norm, radius, children


class CoverTree:
    """Vectors (integers held as exact floats), their ids, and the root over them."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        self.norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.root = self._node(np.arange(len(ids)), 0) if len(ids) else None

    def __getstate__(self):
        """Vectors in the smallest type that holds them."""
        most = float(np.abs(self.vectors).max(initial=0))
        kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64
        return self.vectors.astype(kind), self.ids, self.norms, self.root

    def __setstate__(self, state):
        vectors, self.ids, self.norms, self.root = state
        self.vectors = vectors.astype(np.float64)

    def _distance(self, points: np.ndarray, centre: int) -> np.ndarray:
        away = self.vectors[points] - self.vectors[centre]
        return np.sqrt(np.einsum("ij,ij->i", away, away))

    def _node(self, points: np.ndarray, centre: int) -> Node:
        """Splits with a stack: nesting follows the ratio of distances, not the call stack."""
        root = Node(points, centre, self.norms[centre], 0.0, [])
        todo = [root]
        while todo:
            node = todo.pop()
            near = self._distance(node.points, node.centre)
            node.radius = float(near.max())
            if len(node.points) <= LEAF or node.radius == 0:
                continue
            owner, centres = np.zeros(len(node.points), np.int64), [node.centre]
            while True:
                far = int(np.argmax(near))
                if near[far] <= node.radius / 2 or len(centres) * LEAF >= 4 * len(node.points):
                    break
                distance = self._distance(node.points, int(node.points[far]))
                closer = distance < near
                near[closer], owner[closer] = distance[closer], len(centres)
                centres.append(int(node.points[far]))
            for k, c in enumerate(centres):
                inside = node.points[owner == k]
                if len(inside):
                    node.children.append(Node(inside, c, self.norms[c], 0.0, []))
            todo += node.children
        return root


def _integers(vectors: np.ndarray) -> np.ndarray:
    """The integers that floats stand for; 2^63 stands for the largest, which is no float."""
    over = vectors >= 2.0 ** 63
    return np.where(over, np.iinfo(np.int64).max, np.where(over, 0, vectors).astype(np.int64))


def _products(a: CoverTree, rows: np.ndarray, b: CoverTree, points: np.ndarray) -> np.ndarray:
    """Exact inner products.  No partial sum exceeds the product of the norms."""
    x, y = a.vectors[rows], b.vectors[points]
    if float(a.norms[rows].max()) * float(b.norms[points].max()) * (1 + 1e-9) < _EXACT:
        return np.rint(x @ y.T).astype(np.int64)
    return _integers(x) @ _integers(y).T


class TopK:
    """The k best rows of each query so far, by score and then smaller id."""

    def __init__(self, queries: CoverTree, k: int):
        self.queries, self.k = queries, k
        self.scores = np.full((len(queries.ids), k), _NONE)
        self.ids = np.full((len(queries.ids), k), np.iinfo(np.int64).max)

    def worst(self, node: Node) -> int:
        return int(self.scores[node.points, -1].min())

    def offer(self, node: Node, data: CoverTree, points: np.ndarray) -> None:
        rows = node.points
        scores = _products(self.queries, rows, data, points)
        ids = np.broadcast_to(data.ids[points], scores.shape)
        scores[ids == self.queries.ids[rows][:, None]] = _NONE
        better = scores.max(axis=1) >= self.scores[rows, -1]
        rows = rows[better]
        if len(rows):
            scores = np.concatenate([self.scores[rows], scores[better]], axis=1)
            ids = np.concatenate([self.ids[rows], ids[better]], axis=1)
            ids = np.where(scores == _NONE, np.iinfo(np.int64).max, ids)
            first = np.lexsort((ids, ~scores), axis=-1)[:, :self.k] if scores.shape[1] else None
            self.scores[rows] = np.take_along_axis(scores, first, axis=1)
            self.ids[rows] = np.take_along_axis(ids, first, axis=1)

    def search(self, data: CoverTree) -> None:
        """Meet a tree of data: node pairs with the largest bounds first, pruned where they cannot matter."""
        queries = self.queries

        def bound(q: Node, d: Node) -> float:
            top = (float(queries.vectors[q.centre] @ data.vectors[d.centre]) + q.norm * d.radius + d.norm * q.radius
                   + q.radius * d.radius)
            # Terms may cancel, so rounding is relative to their sizes and not to the sum's.
            return top + 1e-9 * (q.norm + q.radius) * (d.norm + d.radius) + 1e-6

        todo = [(bound(queries.root, data.root), queries.root, data.root)] if queries.root and data.root else []
        while todo:
            top, q, d = todo.pop()
            if top < self.worst(q):
                continue
            if not q.children and not d.children:
                self.offer(q, data, d.points)
                continue
            split_data = bool(d.children) and (not q.children or d.radius >= q.radius)
            pairs = [(q, c) for c in d.children] if split_data else [(c, d) for c in q.children]
            todo += sorted(((bound(a, b), a, b) for a, b in pairs), key=lambda p: p[0])


def integers(vector: Column) -> Column:
    """floor(1024 * x) of each component; null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * 1024).cast("long")))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, vectors) of a batch, by length of vector and in blocks of rows."""
    lists = batch["vector"]
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes, ids = np.diff(offsets), batch["vec_id"].to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for at in range(0, len(rows), DATA_BLOCK):
            some = rows[at:at + DATA_BLOCK]
            yield int(size), ids[some], values[offsets[some][:, None] + np.arange(size)].astype(np.float64)


def _query_trees(queries: DataFrame, folder: str) -> DataFrame:
    """block, size, tree: the file with the tree of each block's queries that have one length."""

    def build(some: pa.Table) -> pa.Table:
        lists, size = some["vector"].combine_chunks(), some["size"][0].as_py()
        vectors = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), size)
        uri, out = new_file(folder, ".queries")
        with out:
            out.write(pickle.dumps(CoverTree(vectors, some["vec_id"].to_numpy())))
        return pa.table({"block": some["block"].slice(0, 1), "size": some["size"].slice(0, 1), "tree": pa.array([uri])})

    return materialise(queries.withColumn("size", F.size("vector")).groupBy("block", "size").applyInArrow(
        build, "block long, size int, tree string"), name="query_trees")


def _data_trees(data: DataFrame, folder: str) -> DataFrame:
    """size, uri, at, n: the files of data trees, and where in them lie the trees of vectors of one length."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, end, places = None, None, 0, {}
        for batch in batches:
            for size, ids, vectors in _matrices(batch):
                if out is None:
                    uri, out = new_file(folder, ".data")
                tree = pickle.dumps(CoverTree(vectors, ids))
                out.write(tree)
                places.setdefault(size, []).append((end, len(tree)))
                end += len(tree)
        if out is not None:
            out.close()
            at, n = ([[p[i] for p in some] for some in places.values()] for i in (0, 1))
            yield pa.record_batch([pa.array(list(places), pa.int32()), pa.array([uri] * len(places)), pa.array(at, pa.list_(pa.int64())),
                                   pa.array(n, pa.list_(pa.int64()))], names=["size", "uri", "at", "n"])

    return materialise(data.mapInArrow(build, "size int, uri string, at array<long>, n array<long>"), name="data_trees")


def top_k(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows of ``table`` for each row where ``is_query`` holds."""
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col)).alias("vector"),
                        F.coalesce(is_query, F.lit(False)).alias("asks")).where("vector IS NOT NULL AND vec_id IS NOT NULL")
    queries = materialise(rows.where("asks").select("vec_id", "vector").distinct(), name="queries")
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    folder = scratch_dir(spark, "trees")
    trees = _query_trees(queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n_blocks)).cast("long")), folder)
    pairs = _data_trees(rows.select("vec_id", "vector"), folder).join(trees, "size")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                with open_file(pair["tree"]) as file:
                    best = TopK(pickle.loads(file.read()), k)
                with open_file(pair["uri"]) as file:
                    for at, n in zip(pair["at"], pair["n"]):
                        best.search(pickle.loads(file.read_at(n, at)))
                row, place = np.nonzero(best.scores != _NONE)
                if len(row):
                    yield pa.record_batch(
                        [pa.array(np.full(len(row), pair["block"], np.int64)), pa.array(row + (pair["size"] << 32)),
                         pa.array(best.queries.ids[row]), pa.array(best.ids[row, place]), pa.array(best.scores[row, place])],
                        names=["block", "query", "query_id", "vec_id", "score"])

    spread = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "tree", "uri")
    found = spread.mapInArrow(search, "block long, query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
