"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Documents above a third of the capacity are matched, at most two in a bin; smaller ones go to the smallest gap that
holds them. Sizes are whole numbers up to the capacity, so the plan is made on the counts of sizes alone: it is as long
as the capacity allows, however many documents there are. Every piece then finds its place from its size and its rank
among the pieces of that size, without meeting the others.
"""

from __future__ import annotations

import bisect
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sparkwarden.llm.bpe import PATTERN, RARE
from sparkwarden.llm.common import chunks, stored

CAPACITY = 1024
END_ID = 2


class _Ids:
    """Ids of texts by a file of the tokenizers library.

    If the file is a plain byte-level BPE (its n-th merge makes the token of rank n, words by the usual pattern), its own
    table of ranks goes to tiktoken's core, which applies the same merges several times faster. Other files, and texts
    with special tokens or rare characters, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            ranks = byte_ranks(json.load(file))
        self.core = None
        if ranks:
            import tiktoken

            self.core = tiktoken.Encoding("core", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.core is not None and RARE.isdisjoint(text) and not any(s in text for s in self.special):
            return self.core.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def byte_ranks(file: dict) -> dict[bytes, int] | None:
    """Token bytes and ranks of a tokenizer file, or None if it is not a plain byte-level BPE."""
    model, split = file["model"], file["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
        and not split.get("add_prefix_space") and not file.get("normalizer") and not file.get("post_processor")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    )
    if not plain:
        return None
    # The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for 256, 257, ...
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    alphabet = {chr(b): b for b in printable}
    alphabet |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    added = {t["content"] for t in file.get("added_tokens") or []}
    ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [ranks.get(bytes(alphabet[c] for c in a + b)) for a, b in pairs]
    return ranks if made == list(range(256, 256 + len(made))) and len(ranks) == 256 + len(made) else None


@lru_cache(maxsize=2)
def _ids(path: str) -> _Ids:
    return _Ids(path)


PIECES = "part int, rank long, piece int, start long, length int, ids_crc32 long"


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: (key, part, rank, piece, start, length, ids_crc32[, ids]).

    A document is its ids and then ``END_ID``. Only documents longer than ``capacity`` are cut: all pieces but the first
    have ``capacity`` ids. ``rank`` counts a task's pieces of one length; with ``part`` it names a piece uniquely. Null
    and empty texts are one piece of one id; repeated rows are packed like others.
    """

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            keys, column = b.column(0), b.column(1)
            for lo, hi in chunks(pc.fill_null(pc.binary_length(column), 0).to_numpy(), 1 << 20):
                ids = _ids(path)
                rows: list[tuple] = []
                for i, text in enumerate(column.slice(lo, hi - lo).to_pylist()):
                    data = ids.of(text or "") + END_ID.to_bytes(4, "little")
                    n = len(data) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        own = data[4 * s : 4 * e]
                        rows.append((lo + i, int(seen[e - s]), k, s, e - s, zlib.crc32(own), own))
                        seen[e - s] += 1
                at, rank, k, s, n, crc, own = zip(*rows)
                columns = [
                    keys.take(pa.array(at)), pa.array([part] * len(at), pa.int32()), pa.array(rank, pa.int64()),
                    pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int32()), pa.array(crc, pa.int64()),
                ]
                names = ["key", "part", "rank", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in own], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, {PIECES}" + ", ids array<int>" * with_ids).withColumnRenamed("key", key)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Where the pieces of each size go: rows (size, first rank, pieces, first bin, pieces per bin, offset), and the bins.

    The rows are bounded by the sizes and gaps there are (both at most ``capacity``), not by the pieces.
    """
    left = {s: n for s, n in counts.items() if n}
    rank = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: ranges (first bin, bins) that have it
    bins = 0

    def put(size: int, n: int, first: int, per: int, offset: int) -> None:
        rows.append((size, rank[size], n, first, per, offset))
        rank[size] += n
        left[size] -= n

    def open_gap(gap: int, first: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        if not left[size]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - size) - 1
        while at >= 0 and not left[large[at]]:
            del large[at]
            at -= 1
        mate = large[at] if at >= 0 else None
        if mate == size and left[size] == 1:
            below = [s for s in large[:at] if left[s]]
            mate = below[-1] if below else None
        if mate is None:
            n, gap = left[size], capacity - size
            put(size, n, bins, 1, 0)
        elif mate == size:
            n, gap = left[size] // 2, capacity - 2 * size
            put(size, 2 * n, bins, 2, 0)
        else:
            n, gap = min(left[size], left[mate]), capacity - size - mate
            put(size, n, bins, 1, 0)
            put(mate, n, bins, 1, size)
        open_gap(gap, bins, n)
        bins += n

    for size in sorted((s for s in left if left[s] and 3 * s <= capacity), reverse=True):
        for gap in sorted(g for g in gaps if g >= size):
            while left[size] and gaps.get(gap):
                first, n = gaps[gap].pop()
                per = gap // size
                whole = min(n, left[size] // per)
                if whole:
                    put(size, whole * per, first, per, capacity - gap)
                    open_gap(gap - per * size, first, whole)
                elif left[size]:
                    rest = left[size]
                    put(size, rest, first, rest, capacity - gap)
                    open_gap(gap - rest * size, first, 1)
                    whole = 1
                open_gap(gap, first + whole, n - whole)
        if left[size]:
            per = capacity // size
            whole, rest = divmod(left[size], per)
            if whole:
                put(size, whole * per, bins, per, 0)
                open_gap(capacity - per * size, bins, whole)
            if rest:
                put(size, rest, bins + whole, rest, 0)
                open_gap(capacity - rest * size, bins + whole, 1)
            bins += whole + bool(rest)
    return rows, bins


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (rows of ``pieces``, written down, so that a task's ranks are final) with ``sequence_id`` and ``offset``.

    Pieces of the same size are interchangeable: their number among all of that size is their rank in their task plus
    the pieces of that size in the tasks before. An empty table gives an empty table.
    """
    per_task = found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r[0]: r[1] for r in found.groupBy("length").agg(F.count(F.lit(1))).collect()}  # at most ``capacity`` rows
    rows, _ = plan(counts, capacity)
    places = np.array(sorted(rows), np.int64).reshape(-1, 6)
    shift = 1 << 52
    starts = places[:, 0] * shift + places[:, 1]

    def run(batches):
        for b in batches:
            length = b.column("length").to_numpy().astype(np.int64)
            rank = b.column("rank").to_numpy() + b.column("base").to_numpy()
            place = places[np.searchsorted(starts, length * shift + rank, "right") - 1]
            k = rank - place[:, 1]
            names = [n for n in b.schema.names if n not in ("part", "rank", "base", "length")]
            columns = [b.column(n) for n in names]
            columns += [
                pa.array(length),
                pa.array(place[:, 3] + k // np.maximum(place[:, 4], 1)),
                pa.array(place[:, 5] + k % np.maximum(place[:, 4], 1) * length),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*names, "length", "sequence_id", "offset"])

    joined = found.join(based, ["part", "length"])
    kept = [f for f in joined.schema if f.name not in ("part", "rank", "base", "length")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return joined.mapInArrow(run, f"{schema}, length long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as places in sequences: (key, piece, start, ids_crc32, length, sequence_id, offset)."""
    return packed(stored(pieces(docs, path, capacity, key, text)), capacity)
