"""Near-duplicate vectors by lattice hashing: random projections decoded to points of the E8 lattice."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkwarden.llm.common import Forest, matrix, mix, stored, whole_groups
from sparkwarden.llm.components import components
from sparkwarden.llm.vectors import usable

TABLES = 6
#: E8 points of a table's key; each takes eight projections.
BLOCKS = 2
#: Length of a lattice step relative to the distance between unit vectors at the wanted cosine.
STEP = 0.85
#: Members of a cell that one task compares with each other; larger cells are dealt out block by block.
CELL = 4096
#: Points of the lattice that a block looks at: its own and the next nearest.
KEYS = ((0, 0), (1, 0), (0, 1), (1, 1))


def minimal() -> np.ndarray:
    """The 240 shortest vectors of E8: permutations of (±1, ±1, 0, ...), and (±½, ...) with an even number of minuses."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for signs in range(256):
        v = np.array([-0.5 if signs >> i & 1 else 0.5 for i in range(8)])
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


SHORTEST = minimal()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8, the whole-number vectors of even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2)
    off = x[odd] - near[odd]
    at = np.abs(off).argmax(1)
    near[odd, at] += np.where(off[np.arange(len(odd)), at] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is D8 and D8 moved by one half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(nearer[:, None], half, whole)


def cells(unit: np.ndarray, tables: int, scale: float, seed: int = 8) -> np.ndarray:
    """Keys (rows x tables x len(KEYS)): per table the cell of the vector and neighbouring cells, nearest points first."""
    n, dim = unit.shape
    draw = np.random.default_rng((seed, dim))
    out = np.empty((n, tables, len(KEYS)), np.uint64)
    for t in range(tables):
        axes = np.linalg.qr(draw.standard_normal((max(dim, 8 * BLOCKS), 8 * BLOCKS)))[0][:dim]
        shift = draw.random(8 * BLOCKS)
        parts = []
        for k in range(BLOCKS):
            x = unit @ axes[:, 8 * k : 8 * k + 8] / scale + shift[8 * k : 8 * k + 8]
            own = decode(x)
            next_ = SHORTEST[((x - own) @ SHORTEST.T).argmax(1)]
            weights = draw.integers(1, 1 << 62, 8).astype(np.uint64) | np.uint64(1)
            parts.append([((2 * p).astype(np.int64).view(np.uint64) * weights).sum(1, dtype=np.uint64) for p in (own, own + next_)])
        for j, (a, b) in enumerate(KEYS):
            out[:, t, j] = mix(mix(parts[0][a]) + parts[1][b] + np.uint64((t << 8) + dim))
    return out


def _units(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(1, keepdims=True)
    scaled = vectors / top
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def _keyed(vectors: DataFrame, tables: int, scale: float) -> DataFrame:
    """Rows (key, vec_id, unit, keys): each vector under each of its cells."""

    def run(batches):
        for b in batches:
            ids, dims = b.column(0).to_numpy(), b.column(1).to_numpy()
            for dim in np.unique(dims):
                for rows in np.array_split(np.flatnonzero(dims == dim), max(1, int((dims == dim).sum()) // 1024)):
                    if not len(rows):
                        continue
                    unit = _units(matrix(b.column(2).take(pa.array(rows)), np.float64))
                    keys = cells(unit, tables, scale).reshape(len(rows), -1).view(np.int64)
                    n = keys.shape[1]
                    packed = pa.array([u.tobytes() for u in unit], pa.binary())
                    all_keys = pa.array([k.tobytes() for k in keys], pa.binary())
                    at = pa.array(np.repeat(np.arange(len(rows)), n))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), pa.array(np.repeat(ids[rows], n)), packed.take(at), all_keys.take(at)],
                        ["key", "vec_id", "unit", "keys"],
                    )

    return vectors.mapInArrow(run, "key long, vec_id long, unit binary, keys binary")


def _dealt(rows: DataFrame, cell: int) -> DataFrame:
    """Rows of cells that have more than one member, with the task's key ``block`` and the side they are on.

    A cell of up to ``cell`` rows is one block. A larger one is cut into parts by id; each pair of parts is a block, so
    that all its pairs are compared, by many tasks.
    """
    counts = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / cell).cast("int")
    rows = rows.join(counts, "key").withColumn("parts", parts)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    return rows.select(
        F.xxhash64("key", low, high).alias("block"), "key", (low != high).alias("two"), (F.col("part") == low).alias("first"),
        "vec_id", "unit", "keys",
    )


def _linked(dealt: DataFrame, cosine: float, tables: int) -> DataFrame:
    """(vec_id, n, root): how many vectors each is linked with first in this block, and a link of the block's forest.

    A pair that shares several cells is counted in the first of them, in the order of tables and of the smaller id's keys.
    """

    def run(batches):
        for rows, starts in whole_groups(batches, "block"):
            ids_all, keys_all = rows["vec_id"].to_numpy(), matrix(rows["keys"], np.int64)
            own, two, first = rows["key"].to_numpy(), rows["two"].to_numpy(), rows["first"].to_numpy()
            units_all = rows["unit"]
            out: list[tuple] = []
            for s, e in zip(starts, starts[1:]):
                if e - s < 2:
                    continue
                ids, keys = ids_all[s:e], keys_all[s:e]
                unit = matrix(units_all.slice(s, e - s), np.float64)
                n, forest = np.zeros(e - s, np.int64), Forest(e - s)
                for lo in range(0, e - s, 512):
                    i, j = np.nonzero(unit[lo : lo + 512] @ unit.T >= cosine)
                    i += lo
                    ahead = ids[i] < ids[j]
                    if two[s]:
                        ahead &= first[s:e][i] != first[s:e][j]
                    i, j = i[ahead], j[ahead]
                    for a, b in zip(i.tolist(), j.tolist()):
                        forest.join(a, b)
                    for at in range(0, len(i), 16_384):
                        x, y = i[at : at + 16_384], j[at : at + 16_384]
                        here = np.zeros(len(x), bool)
                        open_ = np.ones(len(x), bool)
                        width = len(KEYS)
                        for k in range(tables * width):
                            table = slice(k // width * width, k // width * width + width)
                            shared = (keys[x, k][:, None] == keys[y, table]).any(1)
                            here |= open_ & shared & (keys[x, k] == own[s])
                            open_ &= ~shared
                        np.add.at(n, x[here], 1)
                        np.add.at(n, y[here], 1)
                root = np.array([forest.root(i) for i in range(e - s)])
                least = np.full(e - s, np.iinfo(np.int64).max)
                np.minimum.at(least, root, ids)
                some = np.flatnonzero((n > 0) | (root != np.arange(e - s)))
                out += zip(ids[some].tolist(), n[some].tolist(), least[root[some]].tolist())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["vec_id", "n", "root"])

    sorted_ = dealt.repartition("block").sortWithinPartitions("block")
    return sorted_.mapInArrow(run, "vec_id long, n long, root long")


def near_duplicates(
    embeddings: DataFrame, cosine: float = 0.95, tables: int = TABLES, cell: int = CELL, key: str = "vec_id"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings``.

    Two vectors are linked if they share a cell of some table and their cosine in double precision is ``cosine`` or more.
    ``n_links`` counts a vector's links, ``component_id`` is the smallest id that links reach, and ``kept`` marks it.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors link only
    with vectors of their length. Equal vectors are linked. A repeated id is one vector and gets a row each time; a null
    id has no links and a null component. Further columns are ignored; an empty table gives an empty one.
    """
    scale = STEP * math.sqrt(2 - 2 * cosine)
    found = stored(_linked(_dealt(_keyed(usable(embeddings, key), tables, scale), cell), cosine, tables))
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    reached = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    rows = embeddings.select(embeddings[key].cast("long").alias("vec_id"))
    rows = rows.join(links, "vec_id", "left").join(reached.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
