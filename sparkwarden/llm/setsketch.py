"""Near-duplicate documents by SetSketch registers: banded, estimated by likelihood, verified on whole shingle sets.

A register is the largest of exponentially spaced levels that a set's elements reach, so that the registers of a union are
the larger ones of its parts. Sets with equal registers are alike; a band is a few registers that agree together.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkwarden.llm.common import Forest, byte_rows, chunks, frugal, matrix, mix, stored, whole_groups
from sparkwarden.llm.components import components

REGISTERS = 128
#: Registers of a band. At similarity 0.8, one pair in 30 million shares no band of 32.
ROWS = 4
#: Ratio of neighbouring levels, and the rate of an element's exponential variable, which keeps small sets off level 0.
BASE, RATE = 1.05, 20.0
#: Documents that one task compares with each other, and bytes of their texts; larger groups are dealt out block by block.
CELL, BYTES = 1000, 1 << 24
#: A pair is verified unless its estimate is that many standard errors below the threshold.
ERRORS = 4.5

_draw = np.random.default_rng(9)
_odd = lambda n: _draw.integers(1, 1 << 62, n, np.uint64) * np.uint64(2) + np.uint64(1)
#: A byte's value in word hashes; A-Z count as a-z.
_BYTE = _odd(256)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_PLACE = _odd(16)
_TIMES, _PLUS = _odd(REGISTERS), _odd(REGISTERS)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts (data[bounds[i]:bounds[i + 1]]) in order, and where each text's begin."""
    n = len(data)
    inside = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    start = np.flatnonzero(inside & (first[:-1] | ~np.r_[False, inside[:-1]]))
    end = np.flatnonzero(inside & (first[1:] | ~np.r_[inside[1:], False])) + 1
    powers = np.ones(n + 1, np.uint64)
    powers[1:] = _STEP
    powers = np.cumprod(powers)
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * powers[:-1])]
    backs = np.ones(n + 1, np.uint64)
    backs[1:] = _BACK
    backs = np.cumprod(backs)
    hashes = mix((sums[end] - sums[start]) * backs[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, bounds)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each text's begin.

    A shingle is ``words`` words in a row; a text with fewer words has one, all its words; one without words has none.
    """
    hashes, begin = word_hashes(data, bounds)
    count = np.diff(begin)
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(hashes)) - begin[:-1][text]
    size = np.minimum(count, words)[text]
    heads = np.flatnonzero(place <= count[text] - size)
    total = np.zeros(len(heads), np.uint64)
    for k in range(words):
        some = size[heads] > k
        total[some] += hashes[heads[some] + k] * _PLACE[k % 16] + np.uint64(k)
    total, of = mix(total), text[heads]
    order = np.lexsort((total, of))
    total, of = total[order], of[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (of[1:] != of[:-1])
    total, of = total[new], of[new]
    return total, np.searchsorted(of, np.arange(len(count) + 1))


def registers(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SetSketch registers (texts x REGISTERS) of the sets; an empty set has level 0 throughout."""
    out = np.zeros((len(bounds) - 1, REGISTERS), np.uint16)
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return out
    starts = bounds[some]
    for i in range(REGISTERS):
        # An element's exponential variable falls with its hash, so that the least hash has the level of the set.
        least = np.minimum.reduceat((sets * _TIMES[i] + _PLUS[i]) >> np.uint64(32), starts)
        variable = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
        out[some, i] = np.clip(np.floor(1 - np.log(variable) / math.log(BASE)), 0, 65_535)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _ahead(x: np.ndarray) -> np.ndarray:
    """Chance that a register of one set is above the other's, if its own elements are the share x of the union's rates."""
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, steps: int = 60) -> np.ndarray:
    """Similarity of pairs by maximum likelihood of all their registers' orders together, given the sets' sizes."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - above - below
    u = size_a / (size_a + size_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    best, value = np.full(len(a), -np.inf), np.zeros(len(a))
    for k in range(steps + 1):
        j = top * (k / steps)
        plus, minus = _ahead(np.maximum(u - v * j, 1e-12)), _ahead(np.maximum(v - u * j, 1e-12))
        likely = above * np.log(plus) + below * np.log(minus) + same * np.log(np.maximum(1 - plus - minus, 1e-12))
        better = likely > best
        best[better], value[better] = likely[better], j[better]
    return value


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, a, b, registers, bytes) of every document; a and b are a digest of its set."""

    def run(batches):
        for batch in batches:
            data, bounds = byte_rows(batch.column(1))
            for lo, hi in chunks(np.diff(bounds), 1 << 18):
                sets, begin = shingle_sets(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], words)
                other = np.r_[np.uint64(0), np.cumsum(mix(sets * _STEP))]
                sums = np.r_[np.uint64(0), np.cumsum(sets)]
                rows = registers(sets, begin)
                digest = [(s[begin[1:]] - s[begin[:-1]]).view(np.int64) for s in (sums, other)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array(np.diff(begin)), pa.array(digest[0]), pa.array(digest[1]),
                        pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(np.diff(bounds[lo : hi + 1])),
                    ],
                    ["doc_id", "n", "a", "b", "registers", "bytes"],
                )

    return docs.mapInArrow(frugal(run), "doc_id long, n long, a long, b long, registers binary, bytes long")


def _bands(sets: DataFrame) -> DataFrame:
    """(key, id): each set under the hash of every band of its registers."""

    def run(batches):
        for b in batches:
            rows = matrix(b.column("registers"), np.uint16).reshape(b.num_rows, -1, ROWS).astype(np.uint64)
            keys = mix((rows * _PLACE[:ROWS]).sum(2, dtype=np.uint64) + np.arange(rows.shape[1], dtype=np.uint64) * _STEP)
            ids = np.repeat(b.column("id").to_numpy(), rows.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(ids)], ["key", "id"])

    return sets.select("id", "registers").mapInArrow(frugal(run), "key long, id long")


def _margin(percent: int) -> float:
    """Estimate from which a pair may have the similarity."""
    return percent / 100 - ERRORS * math.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)


def _allowed(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of registers may belong to sets of the similarity, by their sizes and the estimate; in small portions."""
    out = 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)
    some = np.flatnonzero(out)
    for at in range(0, len(some), 4096):
        k = some[at : at + 4096]
        out[k] = estimate(a[k], b[k], size_a[k], size_b[k]) >= _margin(percent)
    return out


def _passing(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose registers allow the similarity."""

    def run(batches):
        for rows in batches:
            x, y = (matrix(rows.column(c), np.uint16).reshape(rows.num_rows, -1) for c in ("registers_a", "registers_b"))
            keep = _allowed(x, y, rows.column("n_a").to_numpy(), rows.column("n_b").to_numpy(), percent)
            yield rows.select(["a", "b"]).filter(pa.array(keep))

    for side in ("a", "b"):
        own = sets.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("registers").alias(f"registers_{side}"))
        pairs = pairs.join(own, side)
    return pairs.select("a", "b", "n_a", "registers_a", "n_b", "registers_b").mapInArrow(frugal(run), "a long, b long")


def _candidates(sets: DataFrame, percent: int, cell: int) -> DataFrame:
    """(id, component_id): what pairs that share a band and whose registers allow the similarity join together.

    First each set meets the smallest id of each of its bands. Only bands whose sets are not together after that have all
    their pairs compared, inside tasks, on registers alone.
    """
    bands = _bands(sets)
    shared = bands.groupBy("key").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(bands.join(stored(shared.select("key", "b")), "key"))
    stars = stored(shared.where("id <> b").select(F.col("id").alias("a"), "b").distinct())
    near = stored(components(_passing(stars, sets, percent)))
    placed = shared.select("key", "id").join(near, "id", "left").withColumn("place", F.coalesce("component_id", "id")).drop("component_id")
    placed = stored(placed)
    mixed = placed.groupBy("key").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low < high")
    rows = placed.join(stored(mixed.select("key")), "key").withColumnRenamed("key", "component_id")
    rows = rows.join(sets.select("id", "n", "registers"), "id").withColumn("bytes", F.lit(0))

    def run(batches):
        for group, starts in whole_groups(batches, "block"):
            out: list[tuple[int, int]] = []
            for s, e in zip(starts, starts[1:]):
                if e - s > 1:
                    out += _crossing(group.slice(s, e - s), percent)
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = _dealt(rows, cell).repartition("block").sortWithinPartitions("block")
    crossing = dealt.mapInArrow(frugal(run), "a long, b long")
    return components(near.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(crossing))


def _pairs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows with a third of their registers equal, those with most equal ones first, and how many are."""
    same = np.zeros((len(rows), len(rows)), np.uint8)
    for k in range(REGISTERS):
        same += rows[:, k, None] == rows[None, :, k]
    i, j = np.nonzero(np.triu(same >= REGISTERS // 3, 1))
    order = np.argsort(same[i, j], kind="stable")[::-1]
    return i[order], j[order], same[i, j][order]


def _open_pairs(group: pa.Table, forest: Forest, percent: int):
    """Portions of pairs of a group that the registers allow and that the forest has not joined yet."""
    sizes, rows = group["n"].to_numpy(), matrix(group["registers"], np.uint16)
    i, j, _ = _pairs(rows)
    for at in range(0, len(i), 8192):
        roots = np.array([forest.root(k) for k in range(len(rows))])
        x, y = i[at : at + 8192], j[at : at + 8192]
        apart = roots[x] != roots[y]
        x, y = x[apart], y[apart]
        keep = _allowed(rows[x], rows[y], sizes[x], sizes[y], percent)
        yield zip(x[keep].tolist(), y[keep].tolist())


def _crossing(group: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Pairs that join the sets of a band that are in different places; sets at one place are together already."""
    ids, places = group["id"].to_numpy(), group["place"].to_numpy()
    _, first, place = np.unique(places, return_index=True, return_inverse=True)
    forest, out = Forest(len(ids)), []
    for k, p in enumerate(place.tolist()):
        forest.join(k, int(first[p]))
    for portion in _open_pairs(group, forest, percent):
        out += [(int(ids[x]), int(ids[y])) for x, y in portion if forest.join(x, y)]
    return out


def _dealt(members: DataFrame, cell: int) -> DataFrame:
    """Rows with the task's key ``block``: a group of up to ``cell`` rows and BYTES bytes, or a pair of parts of a larger one."""
    sizes = members.groupBy("component_id").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("total"))
    rows = members.join(stored(sizes), "component_id")
    rows = rows.withColumn("parts", F.greatest(F.ceil(F.col("size") / cell), F.ceil(F.col("total") / BYTES)).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    rows = rows.withColumn("block", F.xxhash64("component_id", low, high))
    return rows.drop("component_id", "size", "total", "bytes", "parts", "part", "other")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, packed): texts compressed, which halves what their join shuffles."""

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for b in batches:
            data, bounds = byte_rows(b.column(1))
            texts = (pa.py_buffer(data[x:y]) for x, y in zip(bounds.tolist(), bounds[1:].tolist()))
            packed = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds)), packed], ["doc_id", "size", "packed"])

    return docs.mapInArrow(frugal(run), "doc_id long, size long, packed binary")


def _links(dealt: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links that join all linked sets of a block, b the smallest id that a reaches there.

    Pairs whose estimate allows the threshold are verified on their whole sets, likeliest first, unless verified links
    join them already.
    """

    def run(batches):
        for rows, starts in whole_groups(batches, "block"):
            out: list[tuple[int, int]] = []
            for s, e in zip(starts, starts[1:]):
                if e - s > 1:
                    out += _joined(rows.slice(s, e - s), words, percent)
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(frugal(run), "a long, b long")


def _joined(group: pa.Table, words: int, percent: int) -> list[tuple[int, int]]:
    order = np.argsort(group["id"].to_numpy())
    group = group.take(pa.array(order))
    ids, n, packed, sizes = group["id"].to_numpy(), len(order), group["packed"], group["size"].to_numpy()
    forest, sets, codec = Forest(n), {}, pa.Codec("zstd")

    def of(k: int) -> np.ndarray:
        if k not in sets:
            data = np.frombuffer(codec.decompress(packed[k].as_buffer(), int(sizes[k])), np.uint8)
            sets[k] = shingle_sets(data, np.array([0, len(data)]), words)[0]
        return sets[k]

    for portion in _open_pairs(group, forest, percent):
        for x, y in portion:
            if forest.root(x) != forest.root(y):
                a, b = of(x), of(y)
                both = len(a) + len(b) - len(np.union1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    forest.join(x, y)
    return [(int(ids[k]), int(ids[forest.root(k)])) for k in range(n) if forest.root(k) != k]


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80, cell: int = CELL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked whose shingle sets have a similarity of ``percent`` hundredths or more, verified on the whole
    sets. ``component_id`` is the smallest id that links reach, ``kept`` marks it. Null and empty texts and texts without
    words have the empty set and link with nothing. A repeated id is read as one text each time and gets a row each time;
    it and all texts with an equal set are one set from the start. A null id is its own null component and kept. Further
    columns are ignored; an empty table gives an empty one.
    """
    picked = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    sketched = stored(_sketched(picked, words))
    full = sketched.where("doc_id IS NOT NULL AND n > 0")
    sets = full.groupBy("a", "b", "n").agg(F.min("doc_id").alias("id"), F.min("registers").alias("registers"), F.max("bytes").alias("bytes"))
    sets = stored(sets)
    members = _candidates(sets, percent, cell).join(sets.select("id", "n", "registers", "bytes"), "id")
    dealt = _dealt(stored(members), cell)
    # Of an id with several texts, the text of this very set must come along.
    texts = _packed(picked)
    texts = texts.join(dealt, texts["doc_id"] == dealt["id"]).select("id", "n", "registers", "block", "size", "packed")
    links = _links(texts, words, percent)
    # Equal sets are one; an id may stand for several sets if its texts differ.
    same = full.select("doc_id", "a", "b", "n").join(sets.select("a", "b", "n", "id"), ["a", "b", "n"])
    same = same.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b")
    reached = components(links.unionByName(same))
    rows = sketched.select("doc_id", F.col("n").alias("n_shingles"))
    rows = rows.join(reached.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
