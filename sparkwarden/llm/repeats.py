"""Repeated byte strings across documents, by the common-prefix interval tree of a sampled, enhanced suffix array.

Every string of ``length`` bytes holds an anchor: the start of its k-gram of least hash, the rightmost of equals. The
anchor depends on the string alone, so equal strings have it at the same place, and a repeat is found from the anchors
that share their k-gram. For each such group the suffixes that begin at its anchors are sorted with their common-prefix
lengths; a stack scan gives the intervals of suffixes with a common prefix, and the longest common extension to the left
within an interval tells which of them are occurrences of a repeat long enough. What an interval and its parents give
for an anchor is one span around it, and the spans of all anchors are all bytes covered by repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkwarden.llm.common import byte_rows, discard, frugal, mix, stored, whole_groups

LENGTH = 200
GRAM = 32
#: Different contexts of one k-gram that one task compares; k-grams with more are settled by counting windows.
CELL = 50_000
#: Bytes handled at a time; long documents go in overlapping parts.
PART = 1 << 19

_draw = np.random.default_rng(7)
_BYTE = _draw.integers(1, 1 << 62, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_STEP, 2 * PART), _powers(_BACK, 2 * PART)


class _Hashes:
    """Hashes of any substrings of some bytes, from running sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _UP[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _DOWN[start])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span, out = 1, keys
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(keys) - width + 1], out[width - span : len(keys) - span + 1])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text, position, k-gram hash, context hash) of all anchors of some texts, in order; the texts fit into one part.

    The context is up to ``length`` bytes before the anchor and from it on, with the two lengths.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = _Hashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = hashes.of(at, at + gram)
    low = np.uint64((1 << 21) - 1)
    least = _least(grams & ~low | (low - at.astype(np.uint64)), length - gram + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = np.flatnonzero(text[: len(least)] == text[length - 1 : length - 1 + len(least)])
    position = (low - (least[whole] & low)).astype(np.int64)
    position = position[np.r_[True, position[1:] != position[:-1]]] if len(position) else position
    of = text[position]
    start, end = bounds[of], bounds[of + 1]
    left, right = np.minimum(position - start, length), np.minimum(end - position, length)
    shape = (left << 16 | right).astype(np.uint64)
    context = mix(hashes.of(position - left, position + right) + shape * _STEP)
    return of, position - start, grams[position], context


def _parts(size: int, length: int):
    """Parts (begin, end, first and last window start) of a long text: each window start is in one part."""
    for first in range(0, size - length + 1, PART):
        last = min(first + PART, size - length + 1)
        yield max(0, first - length), min(size, last + 2 * length), first, last


def _anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram, context, doc_id, sum, at) of every anchor; ``sum`` tells texts of one id apart."""

    def run(batches):
        for b in batches:
            ids, sums = b.column(0), b.column(1)
            data, bounds = byte_rows(b.column(2))
            sizes = np.diff(bounds)
            groups, lo, total = [], 0, 0
            for i, n in enumerate(sizes):
                if i > lo and total + n > PART:
                    groups.append((lo, i))
                    lo, total = i, 0
                total += int(n)
            groups += [(lo, len(sizes))] if len(sizes) else []
            for lo, hi in groups:
                if hi - lo == 1 and sizes[lo] > PART + 2 * length:
                    found, before = [], -1
                    text = data[bounds[lo] : bounds[hi]]
                    for s, e, first, last in _parts(len(text), length):
                        _, at, g, c = anchors(text[s:e], np.array([0, e - s]), length, gram)
                        at = at + s
                        # Windows from ``first`` to ``last`` have their anchors here; margins only serve contexts.
                        own = _owned(text, s, at, first, last, length, gram)
                        own &= at > before
                        if own.any():
                            before = int(at[own][-1])
                        found.append((at[own], g[own], c[own]))
                    at, g, c = (np.concatenate(x) for x in zip(*found))
                    of = np.zeros(len(at), np.int64)
                else:
                    of, at, g, c = anchors(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], length, gram)
                if len(at):
                    take = pa.array(of + lo)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), ids.take(take), sums.take(take), pa.array(at)],
                        ["gram", "context", "doc_id", "sum", "at"],
                    )

    return docs.mapInArrow(frugal(run), "gram long, context long, doc_id long, sum binary, at long")


def _owned(text, s, at, first, last, length, gram) -> np.ndarray:
    """Which anchors belong to a window that starts in [first, last)."""
    lo = first
    hi = last - 1 + length
    only = anchors(text[lo:hi], np.array([0, hi - lo]), length, gram)[1] + lo
    return np.isin(at, only)


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(gram, context, left, right): the bytes around one anchor of each context, read from its document."""
    places = wanted.groupBy("doc_id", "sum").agg(F.collect_list(F.struct("gram", "context", "at")).alias("places"))

    def run(batches):
        codec = pa.Codec("zstd")
        for b in batches:
            kept: list[list] = [[], [], [], []]
            for i in range(b.num_rows):
                text = codec.decompress(b.column(1)[i].as_buffer(), b.column(0)[i].as_py(), asbytes=True)
                for place in b.column(2)[i].as_py():
                    at = place["at"]
                    cut = place["gram"], place["context"], text[max(0, at - length) : at][::-1], text[at : at + length]
                    for column, x in zip(kept, cut):
                        column.append(x)
                if len(kept[0]) >= 10_000 or i + 1 == b.num_rows:
                    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(kept, kinds)], ["gram", "context", "left", "right"]
                    )
                    kept = [[], [], [], []]

    joined = _packed(docs).alias("d").join(places.alias("p"), _same("d", "p")).select("size", "packed", "places")
    return joined.mapInArrow(frugal(run), "gram long, context long, left binary, right binary")


def _same(a: str, b: str):
    """One document on both sides of a join; null ids meet too."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.sum") == F.col(f"{b}.sum"))


def _packed(docs: DataFrame) -> DataFrame:
    """Documents with compressed texts, which halves what their joins shuffle."""

    others = docs.columns[3:]

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for b in batches:
            data, bounds = byte_rows(b.column(2))
            texts = (pa.py_buffer(data[x:y]) for x, y in zip(bounds.tolist(), bounds[1:].tolist()))
            packed = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
            sizes = pa.array(np.diff(bounds))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), sizes, packed, *b.columns[3:]], ["doc_id", "sum", "size", "packed", *others]
            )

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[3:])
    return docs.mapInArrow(frugal(run), f"doc_id long, sum binary, size long, packed binary{kinds}")


def _padded(column, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of at most ``length`` bytes as a matrix, filled up with 255 (which UTF-8 never holds), and their lengths."""
    data, bounds = byte_rows(column)
    size = np.diff(bounds)
    out = np.full((len(size), length), 255, np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(data)) - bounds[:-1][row]] = data
    return out, size


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows, at most ``most``."""
    same = a == b
    first = same.argmin(1)
    return np.minimum(np.where(same.all(1), a.shape[1], first), most)


def _sorted(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Order of the rows by group, then bytes."""
    head = group.astype(">u8").view(np.uint8).reshape(-1, 8)
    keys = np.ascontiguousarray(np.c_[head, rows]).view(f"V{8 + rows.shape[1]}").ravel()
    return np.argsort(keys, kind="stable")


def spans(group: np.ndarray, left, right, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the bytes before it and from it on that repeats of ``length`` bytes or more with its group cover.

    ``left`` (read backwards from the anchor) and ``right`` are Arrow columns of contexts of up to ``length`` bytes.
    """
    n = len(group)
    group = np.unique(group, return_inverse=True)[1].astype(np.int64)
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    lefts, left_size = _padded(left, length)
    rights, right_size = _padded(right, length)
    # The suffixes in order, and the common prefix of each with the next (-1 between groups).
    suffix = _sorted(group, rights)
    a, b = suffix[:-1], suffix[1:]
    prefix = np.where(group[a] == group[b], _common(rights[a], rights[b], np.minimum(right_size[a], right_size[b])), -1)
    # The same from right to left: the order of the contexts read backwards.
    back = _sorted(group, lefts)
    a, b = back[:-1], back[1:]
    shared = np.where(group[a] == group[b], _common(lefts[a], lefts[b], np.minimum(left_size[a], left_size[b])), -1)
    rank = np.empty(n, np.int64)
    rank[back] = np.arange(n)

    def interval(lo: int, hi: int, depth: int) -> None:
        """The suffixes lo to hi share ``depth`` bytes: which have left extensions in common that make a repeat?"""
        by_left = np.sort(rank[suffix[lo : hi + 1]])
        least = np.minimum.reduceat(shared[: by_left[-1]], by_left[:-1])
        # A left extension is as long as that of the nearer neighbour in left order.
        longest = np.maximum(np.r_[0, least], np.r_[least, 0])
        found = longest + depth >= length
        if found.any():
            who = back[by_left[found]]
            before[who] = np.maximum(before[who], longest[found])
            after[who] = np.maximum(after[who], depth)

    # Groups of two need no tree.
    cut = np.r_[True, prefix < 0, True]
    heads = np.flatnonzero(cut)
    size = np.diff(heads)
    two = heads[:-1][size == 2]
    a, b = suffix[two], suffix[two + 1]
    common = _common(lefts[a], lefts[b], np.minimum(left_size[a], left_size[b]))
    found = common + prefix[two] >= length
    for who in (a[found], b[found]):
        before[who], after[who] = common[found], prefix[two][found]
    for head, n_rows in zip(heads[:-1][size > 2].tolist(), size[size > 2].tolist()):
        stack: list[tuple[int, int]] = []  # (depth, first suffix) of the open intervals
        depths = prefix[head : head + n_rows - 1].tolist()
        for i, depth in enumerate([*depths, -1]):
            first = head + i
            while stack and stack[-1][0] > depth:
                inner, first = stack.pop()
                interval(first, head + i, inner)
            if depth > 0 and (not stack or stack[-1][0] < depth):
                stack.append((depth, first))
    return before, after


def _treed(contexts: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for rows, starts in whole_groups(batches, "gram"):
            # Whole groups of some 20,000 rows together, so that the matrices stay small.
            lo = 0
            while lo < len(starts) - 1:
                hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + 20_000, "right")) - 1)
                part = rows.slice(starts[lo], starts[hi] - starts[lo])
                lo = hi
                before, after = spans(part["gram"].to_numpy(), part["left"], part["right"], length)
                some = np.flatnonzero(after)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["gram"].combine_chunks().take(pa.array(some)), part["context"].combine_chunks().take(pa.array(some)),
                        pa.array(before[some]), pa.array(after[some]),
                    ],
                    ["gram", "context", "before", "after"],
                )

    sorted_ = contexts.repartition("gram").sortWithinPartitions("gram")
    return sorted_.mapInArrow(frugal(run), "gram long, context long, before long, after long")


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """What ``_treed`` gives, for k-grams with very many contexts: every window around an anchor is counted by its digest.

    Counts are summed before they are shuffled, and windows of one k-gram go to all tasks.
    """

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows: list[tuple] = []
                for gram, context, left, right in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)):
                    whole = left[::-1] + right
                    for d in range(max(0, length - len(right)), min(len(left), length) + 1):
                        start = len(left) - d
                        digest = hashlib.blake2b(whole[start : start + length], digest_size=16).digest()
                        halves = (int.from_bytes(h, "big", signed=True) for h in (digest[:8], digest[8:]))
                        rows.append((gram, context, d, *halves))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows)], ["gram", "context", "d", "x", "y"]
                )

    windows = stored(contexts.mapInArrow(frugal(run), "gram long, context long, d long, x long, y long"))
    # The anchor is at the same place in equal windows, which the distance d makes part of the key.
    twice = windows.groupBy("gram", "d", "x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = windows.join(twice, ["gram", "d", "x", "y"])
    return found.groupBy("gram", "context").agg(F.max("d").alias("before"), (length - F.min("d")).alias("after"))


def _identified(docs: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, sum, text, with_0, ...); ``sum``, 128 bits, tells apart different texts of one id."""
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    others = [docs[c].alias(f"with_{i}") for i, c in enumerate(carry)]
    return docs.select(docs[key].cast("long").alias("doc_id"), F.unhex(F.md5(t)).alias("sum"), t.alias("text"), *others)


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cell: int = CELL) -> DataFrame:
    """(doc_id, sum, spans array<struct<s, e>>) of the identified documents that hold repeats; spans may overlap."""
    found = stored(_anchored(docs, length, gram))
    many = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), (F.min("context") != F.max("context")).alias("mixed"))
    # Written first: both sides of the join are then plain shuffles, which adaptive execution splits at a common k-gram.
    many = stored(many.where("n > 1").select("gram", "mixed"))
    again = stored(found.join(many, "gram"))
    discard(found, many)
    # One anchor of each context stands for all; a context that is there twice is covered throughout.
    each = again.groupBy("gram", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "sum", "at")).alias("one"), F.first("mixed").alias("mixed")
    )
    each = stored(each.select("gram", "context", "n", "one.*", "mixed"))
    wanted = each.where("mixed").select("gram", "context", "doc_id", "sum", "at")
    per_gram = wanted.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts"))
    crowded = stored(per_gram.where(F.col("contexts") > cell).select("gram"))
    contexts = _cut(docs, wanted, length)
    if crowded.isEmpty():
        reach = _treed(contexts, length)
    else:
        contexts = stored(contexts)
        reach = _treed(contexts.join(crowded, "gram", "left_anti"), length).unionByName(
            _counted(contexts.join(crowded, "gram", "left_semi"), length)
        )
    whole = each.where("n > 1").select("gram", "context", F.lit(length).cast("long").alias("before"), F.lit(length).cast("long").alias("after"))
    reach = stored(whole.unionByName(reach.join(whole.select("gram", "context"), ["gram", "context"], "left_anti")))
    discard(each, crowded)
    spans_ = again.join(reach, ["gram", "context"]).select(
        "doc_id", "sum", F.struct(F.greatest(F.col("at") - F.col("before"), F.lit(0)).alias("s"), (F.col("at") + F.col("after")).alias("e")).alias("span")
    )
    return spans_.groupBy("doc_id", "sum").agg(F.collect_set("span").alias("spans"))


def _runs(spans_: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for s, e in sorted(spans_):
        e = min(e, size)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def without_repeats(
    docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", cell: int = CELL,
    whole_characters: bool = False, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) and the columns ``carry`` for every row of ``docs``.

    Removed is each byte covered by a string of ``length`` bytes that also starts anywhere else in the documents as given,
    the same document included; overlaps count, and matches do not cross documents. ``n_spans`` counts maximal runs.
    With ``whole_characters`` a run is narrowed to whole characters, so that what is left is text. Null and empty texts have no bytes.
    Repeated rows are places of their own, so that they remove each other. A null id is treated like others. Further
    columns are ignored; an empty table gives an empty one.
    """
    named = _identified(docs, key, text)
    spans_ = covered(named, length, GRAM, cell)
    whole = _identified(docs, key, text, carry)
    carried = [f"with_{i}" for i in range(len(carry))]

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches):
        codec = pa.Codec("zstd")
        for b in batches:
            rows: list[tuple] = []
            for doc, size, packed, found in zip(*(c.to_pylist() for c in b.columns[:4])):
                data = codec.decompress(packed, size, asbytes=True) if size else b""
                runs = _runs([(x["s"], x["e"]) for x in found or ()], size)
                if whole_characters:
                    runs = [r for r in (_narrowed(data, s, e) for s, e in runs) if r[0] < r[1]]
                kept, at = [], 0
                for s, e in runs:
                    kept.append(data[at:s])
                    at = e
                kept = b"".join([*kept, data[at:]])
                rows.append((doc, size, size - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*columns, *b.columns[4:]], [*names, *carried])

    joined = _packed(whole).alias("d").join(spans_.alias("s"), _same("d", "s"), "left")
    joined = joined.select("d.doc_id", "size", "packed", "spans", *carried)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields[3:])
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary{kinds}"
    return joined.mapInArrow(frugal(run), schema).withColumnsRenamed(dict(zip(carried, carry)))


def _narrowed(data: bytes, s: int, e: int) -> tuple[int, int]:
    """The run without parts of characters at its ends."""
    while s < e and data[s] & 0xC0 == 0x80:
        s += 1
    while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
        e -= 1
    return s, e
