"""Changed lines between two snapshots of a corpus.

Only files whose text differs are brought together; the line diff of a pair of texts is a helper inside one row.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkwarden.session import stored

# Hunks are handed over from about that many on.
BATCH = 10_000


def split_lines(text: str | None) -> list[str]:
    """Lines without their ends. CR LF and LF end a line; a final line end opens no further line."""
    lines = (text or "").replace("\r\n", "\n").split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def _lengths(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """Lengths of the longest common subsequence of ``a`` and each beginning of ``b``, a machine word of ``b`` at a time."""
    n = len(b)
    masks: dict[int, int] = {}
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    for x, at in places.items():
        bits = np.zeros(n, np.uint8)
        bits[at] = 1
        masks[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = (1 << n) - 1
    v = full
    for x in a:
        mask = masks.get(x)
        if mask is not None:
            u = v & mask
            v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def _common(a: Sequence[int], b: Sequence[int], i: int, j: int) -> Iterator[tuple[int, int]]:
    """Pairs of one longest common subsequence in order, by halving ``a``; memory stays linear."""
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        s, e, t, f = waiting.pop()
        while s < e and t < f and a[s] == b[t]:
            yield i + s, j + t
            s, t = s + 1, t + 1
        if s == e or t == f:
            continue
        if e - s == 1:
            at = next((k for k in range(t, f) if b[k] == a[s]), None)
            if at is not None:
                yield i + s, j + at
            continue
        mid = (s + e) // 2
        before, after = _lengths(a[s:mid], b[t:f]), _lengths(a[mid:e][::-1], b[t:f][::-1])[::-1]
        cut = t + int(np.argmax(before + after))
        waiting += [(mid, e, cut, f), (s, mid, t, cut)]


def _once(lines: Sequence[int]) -> dict[int, int]:
    """Places of lines in the order of their first places; -1 for those that are there more than once."""
    at: dict[int, int] = {}
    for i, x in enumerate(lines):
        at[x] = -1 if x in at else i
    return at


def _anchors(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Places of lines that are there once on both sides: the most of them that keep their order."""
    at_a, at_b = _once(a), _once(b)
    pairs = [(i, at_b[x]) for x, i in at_a.items() if i >= 0 and at_b.get(x, -1) >= 0]
    ends: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(ends, j)
        back[k] = last[p - 1] if p else -1
        if p == len(ends):
            ends.append(j)
            last.append(k)
        else:
            ends[p], last[p] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def matched_lines(old: Sequence[str], new: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs (place in old, place in new) of lines that stay, in order.

    Equal ends go first, then lines that are there once on both sides part the rest, again and again; between them
    it is a longest common subsequence.
    """
    number: dict[str, int] = {}
    a, b = ([number.setdefault(x, len(number)) for x in side] for side in (old, new))
    out: list[tuple[int, int]] = []
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        s, e, t, f = waiting.pop()
        while s < e and t < f and a[s] == b[t]:
            out.append((s, t))
            s, t = s + 1, t + 1
        while s < e and t < f and a[e - 1] == b[f - 1]:
            e, f = e - 1, f - 1
            out.append((e, f))
        if s == e or t == f:
            continue
        left, right = a[s:e], b[t:f]
        if set(left).isdisjoint(right):
            continue
        found = _anchors(left, right)
        if not found:
            out += _common(left, right, s, t)
            continue
        at_s, at_t = s, t
        for i, j in found:
            if at_s < s + i and at_t < t + j:
                waiting.append((at_s, s + i, at_t, t + j))
            out.append((s + i, t + j))
            at_s, at_t = s + i + 1, t + j + 1
        waiting.append((at_s, e, at_t, f))
    return sorted(out)


def line_hunks(old: Sequence[str], new: Sequence[str]) -> list[tuple[int, int, int, int]]:
    """(start, end, old start, old end) of each change, lines from 1, ends exclusive; a pure removal has start = end."""
    out, i, j = [], 0, 0
    for x, y in [*matched_lines(old, new), (len(old), len(new))]:
        if x > i or y > j:
            out.append((j + 1, y + 1, i + 1, x + 1))
        i, j = x + 1, y + 1
    return out


def snapshot_hunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """``repo, path, start_line, end_line, old_start, old_end`` of the changes of each file of ``new``; ends are exclusive.

    Files that ``old`` has not are one change; files that are gone have no row, as no line of theirs is left. Null texts count as
    empty. A path that is there more than once is compared by its first text in order. Digests decide which files differ, so that
    only texts of changed files are joined.
    """
    digest = F.md5(F.coalesce("content", F.lit(""))).alias("digest")
    olds = old.groupBy("repo", "path").agg(F.min(F.struct(digest)).alias("o"))
    news = new.groupBy("repo", "path").agg(F.min(F.struct(digest)).alias("n"))
    changed = news.join(olds, ["repo", "path"], "left").where("NOT (o.digest <=> n.digest)")
    changed = stored(changed.select("repo", "path", "o.digest", F.col("n.digest").alias("new_digest")))

    def texts(files: DataFrame, wanted: str, name: str) -> DataFrame:
        keys = changed.select("repo", "path", F.col(wanted).alias("digest")).where("digest IS NOT NULL")
        rows = files.select("repo", "path", digest, F.coalesce("content", F.lit("")).alias(name))
        return rows.join(keys, ["repo", "path", "digest"], "left_semi").dropDuplicates(["repo", "path"]).drop("digest")

    pairs = texts(new, "new_digest", "new").join(texts(old, "digest", "old"), ["repo", "path"], "left")
    fields = ["repo", "path", "start_line", "end_line", "old_start", "old_end"]

    def batch(rows):
        kinds = [pa.string(), pa.string(), *[pa.int32()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], fields)

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for repo, path, after, before in zip(*(b.column(i).to_pylist() for i in range(4))):
                rows += [(repo, path, *hunk) for hunk in line_hunks(split_lines(before), split_lines(after))]
                if len(rows) >= BATCH:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    schema = "repo string, path string, start_line int, end_line int, old_start int, old_end int"
    return pairs.select("repo", "path", "new", "old").mapInArrow(run, schema)
