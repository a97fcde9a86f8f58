"""Nearest neighbours by inner product from a vantage-point tree per shard."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparkwarden.llm.common import matrix, stored, whole_groups
from sparkwarden.llm.vectors import usable

#: Vectors of a shard and queries of a block, on average.
SHARD = 8192
LEAF = 128
#: Distances carry rounding errors of about this size; no subtree is pruned within it.
SLACK = 1e-9


class Tree:
    """Vantage-point tree over vectors whose largest inner product is asked for.

    One more coordinate, sqrt(reach - |x|²), puts all vectors on one sphere, so that nearness by Euclidean distance is
    nearness by inner product and the triangle inequality holds. A node halves its vectors by their distance from a
    vantage point and knows the least and largest distance in either half.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, reach: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        extra = np.sqrt(np.maximum(reach - (self.vectors**2).sum(1), 0))
        self.points = np.c_[self.vectors, extra]
        self.order = np.arange(len(ids))
        self.nodes: list[tuple] = []  # (start, end, vantage, cut, bounds of the inner and outer half, children)
        self.draw = np.random.default_rng(len(ids))
        if len(ids):
            self._build(0, len(ids))

    def _build(self, start: int, end: int) -> int:
        at = len(self.nodes)
        self.nodes.append((start, end, -1, 0.0, (0.0, 0.0, 0.0, 0.0), (-1, -1)))
        if end - start <= LEAF:
            return at
        mine = self.order[start:end]
        vantage = int(mine[self.draw.integers(len(mine))])
        far = np.sqrt(((self.points[mine] - self.points[vantage]) ** 2).sum(1))
        by = np.argsort(far, kind="stable")
        self.order[start:end], far = mine[by], far[by]
        half = len(mine) // 2
        bounds = (far[0], far[half - 1], far[half], far[-1])
        children = self._build(start, start + half), self._build(start + half, end)
        self.nodes[at] = (start, end, vantage, float(far[half]), tuple(map(float, bounds)), children)
        return at

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores (queries x k; id -1 and score -inf where there are fewer), best first, ties to smaller ids.

        A half is skipped if ``factor`` times the triangle inequality's lower bound exceeds the k-th distance: with 1
        the search is exact, above 1 it skips more.
        """
        m = len(queries)
        best = np.full((m, k), -np.inf)
        found = np.full((m, k), np.iinfo(np.int64).max)
        if not m or not self.nodes:
            return np.full((m, k), -1), best
        reach = float((self.points[0] ** 2).sum())
        square = (queries**2).sum(1)
        points = np.c_[queries, np.zeros(m)]

        def visit(node: int, who: np.ndarray) -> None:
            if not len(who):
                return
            start, end, vantage, cut, (a, b, c, d), (inner, outer) = self.nodes[node]
            if vantage < 0:
                self._look(self.order[start:end], who, query_ids, queries, best, found)
                return
            far = np.sqrt(((points[who] - self.points[vantage]) ** 2).sum(1))
            near = far < cut
            visit(inner, who[near])
            visit(outer, who[~near])
            kth = np.sqrt(np.maximum(reach + square[who] - 2 * best[who, -1], 0)) + SLACK
            out_of = np.maximum(c - far, far - d)
            into = np.maximum(a - far, far - b)
            visit(outer, who[near & (factor * out_of <= kth)])
            visit(inner, who[~near & (factor * into <= kth)])

        visit(0, np.arange(m))
        return np.where(np.isinf(best), -1, found), best

    def _look(self, rows, who, query_ids, queries, best, found) -> None:
        scores = queries[who] @ self.vectors[rows].T
        scores[query_ids[who][:, None] == self.ids[rows][None, :]] = -np.inf
        some = scores.max(1) >= best[who, -1] - SLACK
        who, scores = who[some], scores[some]
        if not len(who):
            return
        # What is close to the k-th score is scored again, row by row, so that equal vectors have equal scores.
        q, r = np.nonzero(scores >= best[who, -1:] - SLACK)
        exact = np.full(scores.shape, -np.inf)
        for at in range(0, len(q), 65_536):
            i, j = q[at : at + 65_536], r[at : at + 65_536]
            exact[i, j] = np.where(np.isinf(scores[i, j]), -np.inf, (queries[who[i]] * self.vectors[rows[j]]).sum(1))
        every = np.c_[best[who], exact]
        ids = np.c_[found[who], np.broadcast_to(self.ids[rows], exact.shape)]
        first = np.lexsort((ids, -every), axis=1)[:, : best.shape[1]]
        best[who] = np.take_along_axis(every, first, 1)
        found[who] = np.take_along_axis(ids, first, 1)

    def dump(self) -> bytes:
        out = io.BytesIO()
        nodes = np.array([(s, e, v, cut, *bounds, *children) for s, e, v, cut, bounds, children in self.nodes], float)
        np.savez(out, ids=self.ids, vectors=self.vectors, points=self.points, order=self.order, nodes=nodes)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        tree, kept = cls.__new__(cls), np.load(io.BytesIO(data))
        tree.ids, tree.vectors, tree.points, tree.order = (kept[n] for n in ("ids", "vectors", "points", "order"))
        tree.nodes = [(int(n[0]), int(n[1]), int(n[2]), n[3], tuple(n[4:8]), (int(n[8]), int(n[9]))) for n in kept["nodes"]]
        return tree


def index(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """One tree per shard of about ``shard`` vectors of equal length: (dim, shard, tree binary). Every vector is in one."""
    total, reach = vectors.agg(F.count(F.lit(1)), F.max(_square("vector"))).first()
    shards = max(1, -(-total // shard))
    dealt = vectors.select(
        "*", F.format_string("%d/%d", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).alias("shard")
    )
    reach = float(reach or 0)

    def build(batches):
        for rows, starts in whole_groups(batches, "shard"):
            for s, e in zip(starts, starts[1:]):
                part = rows.slice(s, e - s)
                tree = Tree(part["vec_id"].to_numpy(), matrix(part["vector"], np.float64), reach)
                yield pa.RecordBatch.from_arrays(
                    [part["dim"].chunk(0).slice(0, 1), part["shard"].chunk(0).slice(0, 1), pa.array([tree.dump()], pa.binary())],
                    ["dim", "shard", "tree"],
                )

    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(build, "dim int, shard string, tree binary")


def _square(vector: str):
    """Squared length of a packed vector."""

    @F.pandas_udf("double")
    def square(column):
        return column.map(lambda x: float((np.frombuffer(x) ** 2).sum()))

    return square(F.col(vector))


def nearest(queries: DataFrame, trees: DataFrame, k: int = 20, factor: float = 1.0, block: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query among all rows with another id.

    Queries go in blocks of about ``block`` to every shard's tree; each gives at most k rows per query, and the best k
    of them stay. Fewer than k candidates give fewer rows; a query without candidates none. Vectors meet only vectors of
    their own length.
    """
    total = queries.count()
    blocks = max(1, -(-total // block))
    dealt = queries.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    packed = dealt.groupBy("dim", "block").agg(
        F.sort_array(F.collect_list(F.struct("vec_id", "vector"))).alias("queries")
    )

    def search(batches):
        for b in batches:
            for row in b.to_pylist():
                tree = Tree.load(row["tree"])
                ids = np.array([q["vec_id"] for q in row["queries"]], np.int64)
                vectors = np.array([np.frombuffer(q["vector"]) for q in row["queries"]])
                found, scores = tree.search(ids, vectors, k, factor)
                real = ~np.isinf(scores)
                of = np.broadcast_to(ids[:, None], found.shape)[real]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of), pa.array(found[real]), pa.array(scores[real])], ["query_id", "vec_id", "score"]
                )

    # Blocks and trees are large rows: a few of them to a task.
    met = trees.join(packed, "dim").repartition("shard", "block")
    rows = met.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, every: int = 20, k: int = 20, factor: float = 1.0) -> DataFrame:
    """Nearest rows of all rows for the queries, the rows whose id is divisible by ``every``."""
    vectors = stored(usable(embeddings))
    return nearest(vectors.where(F.col("vec_id") % every == 0), stored(index(vectors)), k, factor)
