"""Centroid clustering of whole-number vectors, with heaps of bounds that tell which vectors must be looked at again.

A vector's gap is a lower bound on its distance to every other centroid less an upper bound on that to its own. When
centroids move, the gaps of all vectors of a cluster shrink by the same amount at most: the cluster's drift. So a gap is
kept once, with the drift so far added, in its cluster's heap, and has expired when the cluster's drift reaches it. Only
those vectors are popped and compared with all centroids again.

Vectors stay in blocks that Spark reads and writes; centroids and drifts, ``clusters`` times the dimension in size, go along
with the tasks, and per round the sums of the vectors that moved come back, added up by Spark.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkwarden.llm.common import stored

#: Vectors of a block.
BLOCK = 4096
#: Components of a vector are within this bound after scaling, so that squared distances fit 64 bits up to 1024 components.
LARGEST = 1 << 25
#: Components of that size and fewer than 1024 of them are multiplied in doubles without rounding.
_EXACT = 1 << 20
#: More than what a few roundings of doubles add up to, as a share of the values.
_SLACK = 1e-12

_BLOCKS = (
    "ids array<bigint>, others array<bigint>, width int, vectors binary, assigned binary, sizes binary, keys binary, members binary, "
    "moved binary"
)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of two integer matrices."""
    large = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) >= _EXACT
    v, c = (vectors.astype(np.int64), centroids) if large else (vectors.astype(float), centroids.astype(float))
    d = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]
    return d.astype(np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid (of equals the smallest), its squared distance, and the gap to the others."""
    d = squared(vectors, centroids)
    rows = np.arange(len(d))
    best = d.argmin(1)
    least = d[rows, best].copy()
    if d.shape[1] == 1:
        return best, least, np.full(len(d), np.inf)
    d[rows, best] = np.iinfo(np.int64).max
    return best, least, np.sqrt(d.min(1)) * (1 - _SLACK) - np.sqrt(least) * (1 + _SLACK)


class Heaps:
    """One heap of (key, vector) per cluster; a key is a gap with the cluster's drift at that time added."""

    def __init__(self, clusters: int):
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(clusters)]

    def push(self, cluster: int, gap: float, drift: float, vector: int) -> None:
        heapq.heappush(self.heaps[cluster], (gap + drift - _SLACK * (abs(gap) + drift) if gap < np.inf else gap, vector))

    def expired(self, drifts: np.ndarray) -> list[int]:
        """Takes out the vectors whose gap the drift of their cluster has used up."""
        out = []
        for heap, drift in zip(self.heaps, drifts.tolist()):
            drift += _SLACK * (drift + 1)
            while heap and heap[0][0] <= drift:
                out.append(heapq.heappop(heap)[1])
        return out

    def packed(self) -> list[bytes]:
        items = [x for heap in self.heaps for x in heap]
        keys, members = zip(*items) if items else ((), ())
        return [np.array([len(h) for h in self.heaps], np.int32).tobytes(), np.array(keys, float).tobytes(), np.array(members, np.int32).tobytes()]

    @classmethod
    def unpacked(cls, sizes: bytes, keys: bytes, members: bytes) -> Heaps:
        sizes = np.frombuffer(sizes, np.int32)
        items = list(zip(np.frombuffer(keys, float).tolist(), np.frombuffer(members, np.int32).tolist()))
        out, at = cls(len(sizes)), 0
        for j, n in enumerate(sizes.tolist()):
            out.heaps[j], at = items[at : at + n], at + n
        return out


def drifts_after(drifts: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much gaps have shrunk since the start: a centroid's own moves and the farthest moves of the others."""
    moves = np.sqrt(((new.astype(object) - old.astype(object)) ** 2).sum(1).astype(float)) * (1 + _SLACK)
    others = np.array([np.delete(moves, j).max(initial=0.0) for j in range(len(moves))])
    return (drifts + moves + others) * (1 + _SLACK)


def _moved(vectors: np.ndarray, before: np.ndarray, after: np.ndarray, clusters: int) -> bytes:
    """What the vectors' new places add to the clusters' component sums and counts; before is -1 at first."""
    out = np.zeros((clusters, vectors.shape[1] + 1), np.int64)
    ones = np.c_[vectors.astype(np.int64), np.ones(len(vectors), np.int64)]
    np.add.at(out, after, ones)
    np.subtract.at(out, before[before >= 0], ones[before >= 0])
    return out.tobytes()


def _whole(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, integers) of the arrays of ``dim`` finite components; components times ``scale``, rounded down."""
    size = column.value_lengths().fill_null(-1).to_numpy()
    right = np.flatnonzero(size == dim)
    flat = column.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    fine = np.isfinite(flat).all(1)
    with np.errstate(over="ignore"):
        return right[fine], np.floor(flat[fine] * scale)


def _first(batches, dim: int, scale: int, centroids: np.ndarray):
    """Blocks of vectors with their nearest centroids; those out of bounds only have their ids kept."""
    k = len(centroids)
    for b in batches:
        rows, values = _whole(b.column(1), dim, scale)
        fits = (np.abs(values) <= LARGEST).all(1)
        keys = b.column(0)
        others = keys.take(pa.array(rows[~fits])).to_pylist()
        rows, values = rows[fits], values[fits].astype(np.int32)
        for at in range(0, max(len(rows), 1), BLOCK):
            v, ids = values[at : at + BLOCK], keys.take(pa.array(rows[at : at + BLOCK])).to_pylist()
            best, _, gaps = nearest(v, centroids)
            heaps = Heaps(k)
            for i, (c, gap) in enumerate(zip(best.tolist(), gaps.tolist())):
                heaps.push(c, gap, 0.0, i)
            width = 2 if np.abs(v).max(initial=0) < 1 << 15 else 4
            moved = _moved(v, np.full(len(v), -1), best, k)
            yield _row([ids, others, width, v.astype(f"<i{width}").tobytes(), best.astype("<i4").tobytes(), *heaps.packed(), moved])
            others = []


def _again(batches, dim: int, centroids: np.ndarray, drifts: np.ndarray):
    """The blocks after the centroids moved: what expired is compared with all centroids, the rest stays as it is."""
    k = len(centroids)
    for b in batches:
        for r in b.to_pylist():
            v, assigned, heaps = _open(r, dim)
            some = np.array(heaps.expired(drifts), np.int64)
            best, _, gaps = nearest(v[some], centroids)
            for i, c, gap in zip(some.tolist(), best.tolist(), gaps.tolist()):
                heaps.push(c, gap, drifts[c], i)
            changed = best != assigned[some]
            moved = _moved(v[some[changed]], assigned[some[changed]], best[changed], k)
            assigned[some] = best
            yield _row([r["ids"], r["others"], r["width"], r["vectors"], assigned.astype("<i4").tobytes(), *heaps.packed(), moved])


def _last(batches, dim: int, centroids: np.ndarray, drifts: np.ndarray):
    """(vec_id, cluster, distance) of all vectors at the final centroids."""
    for b in batches:
        for r in b.to_pylist():
            v, assigned, heaps = _open(r, dim)
            some = np.array(heaps.expired(drifts), np.int64)
            assigned[some] = nearest(v[some], centroids)[0]
            apart = v.astype(np.int64) - centroids[assigned]
            distances, rest = (apart * apart).sum(1), len(r["others"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(r["ids"] + r["others"], pa.int64()), pa.array(assigned.tolist() + [None] * rest, pa.int32()),
                    pa.array(distances.tolist() + [None] * rest, pa.int64()),
                ],
                ["vec_id", "cluster", "distance"],
            )


def _open(r: dict, dim: int) -> tuple[np.ndarray, np.ndarray, Heaps]:
    v = np.frombuffer(r["vectors"], f"<i{r['width']}").reshape(-1, dim)
    return v, np.frombuffer(r["assigned"], "<i4").astype(np.int64), Heaps.unpacked(r["sizes"], r["keys"], r["members"])


def _row(values: list) -> pa.RecordBatch:
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), *[pa.binary()] * 6]
    names = [f.split()[0] for f in _BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], names)


def _totals(blocks: DataFrame, clusters: int, dim: int) -> np.ndarray:
    """The sum of all blocks' moves; a task sends one row per cluster, and as many rows come back."""

    def run(batches):
        total = np.zeros((clusters, dim + 1), np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, np.int64).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(range(clusters), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "x"])

    sums = blocks.select("moved").mapInArrow(run, "cluster int, x array<bigint>")
    sums = sums.groupBy("cluster").agg(*[F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(dim + 1)])
    out = np.zeros((clusters, dim + 1), np.int64)
    for r in sums.collect():
        out[r[0]] = r[1:]
    return out


def _seeds(vectors: DataFrame, clusters: int, dim: int, scale: int, salt: str) -> np.ndarray:
    """The vectors with the smallest digest of salt and id; equal ids by their components. At most ``clusters`` rows are collected."""
    rows = vectors.where((F.size("vector") == dim) & F.forall("vector", lambda x: _fits(x, scale)))
    rows = rows.orderBy(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), "vector").limit(clusters)
    found = np.array([r.vector for r in rows.select("vector").collect()], float).reshape(-1, dim)
    return np.floor(found * scale).astype(np.int64)


def _fits(x: Column, scale: int) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (x * scale < LARGEST + 1) & (x * scale >= -LARGEST)


def clustered(
    embeddings: DataFrame, clusters: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2",
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of ``dim`` finite components.

    Components are multiplied by ``scale`` and rounded down; all further work is on whole numbers and exact. The first
    centroids are the vectors with the smallest SHA-256 of ``salt:id``; each round assigns every vector to the nearest
    centroid (ties: the smaller number) and moves each non-empty centroid to its vectors' mean, rounded down. With fewer
    vectors than clusters each vector is a first centroid. Vectors that are null, of another length or hold null or
    non-finite components have no row. A vector with a scaled component beyond LARGEST takes no part and has a row without cluster.
    Repeated rows count each time; a null id is an id like others; further columns are ignored; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(embeddings[key].cast("long").alias("vec_id"), embeddings[vector].cast("array<double>").alias("vector"))
    centroids = _seeds(rows, clusters, dim, scale, salt)
    k = len(centroids)
    schema = "vec_id long, cluster int, distance long"
    if k:
        start = centroids
        blocks = stored(rows.mapInArrow(lambda batches: _first(batches, dim, scale, start), _BLOCKS))
        totals, drifts = np.zeros((k, dim + 1), np.int64), np.zeros(k)
        for n in range(rounds):
            totals = totals + _totals(blocks, k, dim)
            new = centroids.copy()
            some = totals[:, dim] > 0
            new[some] = totals[some, :dim] // totals[some, dim:]
            drifts = drifts_after(drifts, centroids, new)
            centroids = new
            if n + 1 < rounds:
                now = (dim, centroids, drifts)
                blocks = stored(blocks.mapInArrow(lambda batches, now=now: _again(batches, *now), _BLOCKS))
        now = (dim, centroids, drifts)
        done = stored(blocks.mapInArrow(lambda batches: _last(batches, *now), schema))
    else:
        out_of_bounds = rows.where((F.size("vector") == dim) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        done = out_of_bounds.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    sums = [(r[0], r[1]) for r in done.groupBy("cluster").agg(F.try_sum("distance")).collect() if r[0] is not None]
    total = sum(s for _, s in sums if s is not None) if sums and all(s is not None for _, s in sums) else None
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    told = spark.createDataFrame([(c, s, digest[c]) for c, s in sums], "cluster int, cluster_inertia long, centroid_sha256 string")
    total = total if total is not None and total < 1 << 63 else None
    return done.join(told, "cluster", "left").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256"
    )
