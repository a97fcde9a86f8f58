"""Byte-level BPE as a finite-state transducer, with a streaming decoder."""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkwarden.llm.common import byte_rows, texts_of

#: The code points of the pattern's white space.
WHITE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


#: Fixed value: public_tokenizers.PATTERN.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern in the standard library's own classes, right for texts without a character of RARE.
USUAL = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


#: What the standard library classes otherwise: numbers that are no decimal digits, and the separators 28 to 31.
RARE = frozenset("\x1c\x1d\x1e\x1f").union(
    c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No")
)


def pieces(text: str) -> list[str]:
    """The matches of PATTERN in a text."""
    return (USUAL if RARE.isdisjoint(text) else splitter()).findall(text)


@lru_cache(maxsize=1)
def splitter() -> re.Pattern:
    """PATTERN for the standard library, with its Unicode classes written out."""

    def ranges(kind: str) -> str:
        codes = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == kind]
        out, start = [], None
        for i, c in enumerate(codes):
            start = c if start is None else start
            if i + 1 == len(codes) or codes[i + 1] != c + 1:
                out.append(f"{chr(start)}-{chr(c)}" if c > start else chr(c))
                start = None
        return "".join(out)

    letters, numbers = ranges("L"), ranges("N")
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{WHITE}{letters}{numbers}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
    )


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tokens of a piece by repeatedly joining the neighbours of lowest rank, leftmost first: the definition."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, sys.maxsize), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == sys.maxsize:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """The merges compiled into a transducer that reads bytes and emits tokens, determinised as inputs demand.

    A state is the bytes read since the last settled token boundary. After a byte, the token that will cover it starts at
    one of the places from which the bytes read so far begin some token of the vocabulary; tokens left of a boundary do
    not depend on what is right of it. So what the segmentations up to all these places have in common at their start is
    settled: it is emitted, and the rest is the next state. The lookahead is thereby less than the longest token plus the
    part on which the segmentations differ.

    Transitions are worked out when an input first takes them, and kept in a hash table of arrays, so that many pieces
    move on by one byte at a time together. At ``max_states`` states all are dropped, as lazily built automata do.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 250_000):
        self.ranks, self.max_states = ranks, max_states
        self.starts = {t[:n] for t in ranks for n in range(1, len(t) + 1)}
        self.bytes_of = {r: t for t, r in ranks.items()}
        #: Runs of ids that are emitted together, one after the other in ``pool``; run 0 is empty.
        self.runs: dict[tuple[int, ...], int] = {(): 0}
        self.pool, self.pool_start = [], [0, 0]
        self._reset()

    def _reset(self) -> None:
        self.rest, self.number, self.ends = [b""], {b"": 0}, [0]
        self.size = 1 << 16
        self.keys, self.values = np.full(self.size, -1), np.zeros(self.size, np.int64)
        self.filled = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x1E3779B97F4A7C15 >> 20) & (self.size - 1)

    def _run(self, ids: tuple[int, ...]) -> int:
        run = self.runs.get(ids)
        if run is None:
            run = self.runs[ids] = len(self.runs)
            self.pool += ids
            self.pool_start.append(len(self.pool))
        return run

    @lru_cache(maxsize=400_000)
    def tokens(self, piece: bytes) -> tuple[int, ...]:
        if len(piece) == 1:
            return (self.ranks[piece],)
        return tuple(merge(piece, self.ranks))

    def _step(self, state: bytes, byte: int) -> tuple[bytes, tuple[int, ...]]:
        read = state + bytes((byte,))
        paths = [self.tokens(read[:j]) if j else () for j in range(len(read)) if read[j:] in self.starts]
        settled = min(map(len, paths))
        for i in range(settled):
            if any(p[i] != paths[0][i] for p in paths):
                settled = i
                break
        out = paths[0][:settled]
        return read[sum(len(self.bytes_of[t]) for t in out) :], out

    def _new(self, key: int) -> int:
        """Works out the move ``key`` = state * 256 + byte: next state << 32 | run."""
        rest, emitted = self._step(self.rest[key >> 8], key & 255)
        after = self.number.get(rest)
        if after is None:
            after = self.number[rest] = len(self.rest)
            self.rest.append(rest)
            self.ends.append(self._run(self.tokens(rest) if rest else ()))
        return after << 32 | self._run(emitted)

    def _keep(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.filled += len(keys)
        if 2 * self.filled >= self.size:
            old = self.keys[self.keys >= 0], self.values[self.keys >= 0]
            while 2 * self.filled >= self.size:
                self.size *= 2
            self.keys, self.values = np.full(self.size, -1), np.zeros(self.size, np.int64)
            self._put(*old)
        self._put(keys, values)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & (self.size - 1)

    def _moves(self, keys: np.ndarray) -> np.ndarray:
        """Values (next state << 32 | run) of moves; new ones are worked out."""
        out, todo = np.empty(len(keys), np.int64), np.arange(len(keys))
        at, missing = self._slot(keys), []
        while len(todo):
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            missing.append(todo[there < 0])
            on = ~hit & (there >= 0)
            todo, at = todo[on], (at[on] + 1) & (self.size - 1)
        missing = np.concatenate(missing) if missing else todo
        if len(missing):
            new = np.unique(keys[missing])
            self._keep(new, np.array(list(map(self._new, new.tolist()))))
            out[missing] = self._moves(keys[missing])
        return out

    def encode_all(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces (bytes data[bounds[i]:bounds[i + 1]]), one after the other, and where each piece's begin."""
        if len(self.rest) >= self.max_states:
            self._reset()
        begin, size = bounds[:-1], np.diff(bounds)
        n = len(size)
        order = np.argsort(-size, kind="stable")
        state = np.zeros(n, np.int64)
        pieces_, runs_ = [], []
        for k in range(int(size.max(initial=0))):
            order = order[: np.searchsorted(-size[order], -k, "left")]  # longer than k
            value = self._moves(state[order] << 8 | data[begin[order] + k])
            state[order] = value >> 32
            run = value & 0xFFFFFFFF
            some = np.flatnonzero(run)
            pieces_.append(order[some])
            runs_.append(run[some])
        pieces_.append(np.arange(n))
        runs_.append(np.array(self.ends)[state])
        piece, run = np.concatenate(pieces_), np.concatenate(runs_)
        by = np.argsort(piece, kind="stable")
        piece, run = piece[by], run[by]
        start = np.array(self.pool_start)
        ids, length = ragged(np.array(self.pool, np.int32), start[run], start[run + 1] - start[run])
        return ids, np.r_[0, np.cumsum(np.bincount(piece, length, n)).astype(np.int64)]

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one piece."""
        return tuple(self.encode_all(np.frombuffer(piece, np.uint8), np.array([0, len(piece)]))[0].tolist())


def ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start[i] : start[i] + size[i]] for all i, one after the other, and the sizes."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(start - ends + size, size) + np.arange(total)], size


class Utf8Stream:
    """Incremental UTF-8: takes bytes in any portions, gives the text that is complete, keeps an unfinished character.

    Its state is the unfinished character's bytes (at most three). Bytes that cannot be UTF-8 give U+FFFD and clear
    ``valid``.
    """

    #: Length of the character that a lead byte opens, by its upper five bits; 0 for a continuation byte.
    LENGTH = [1] * 16 + [0] * 8 + [2] * 4 + [3] * 2 + [4, 1]

    def __init__(self):
        self.state, self.valid = b"", True

    def feed(self, data: bytes) -> str:
        data = self.state + data
        cut = len(data)
        for back in range(1, min(4, len(data)) + 1):
            need = self.LENGTH[data[-back] >> 3]
            if need:
                cut = len(data) - back if need > back else cut
                break
        self.state = data[cut:]
        return self._text(data[:cut])

    def close(self) -> str:
        rest, self.state = self.state, b""
        return self._text(rest)

    def _text(self, data: bytes) -> str:
        try:
            return data.decode()
        except UnicodeDecodeError:
            self.valid = False
            return data.decode(errors="replace")


class Codec:
    """Encoder and decoder for whole texts; one for each Python worker."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.machine = Transducer(ranks)
        self.table = [self.machine.bytes_of.get(i, b"") for i in range(max(ranks.values()) + 1)]
        self.names = [str(i) for i in range(len(self.table))]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. A piece that several hold goes through the transducer once; one that is a token is that."""
        split = list(map(pieces, texts))
        each = pa.array(list(chain.from_iterable(split)), pa.string()).dictionary_encode()
        if not len(each):
            return [[] for _ in texts]
        different = each.dictionary
        whole = np.array([self.machine.ranks.get(p.encode(), -1) for p in different.to_pylist()])
        data, bounds = byte_rows(different.filter(pa.array(whole < 0)))
        ids, starts = self.machine.encode_all(data, bounds)
        # Of all different pieces: where their ids begin in ``ids`` with the whole tokens behind, and how many they are.
        start, size = np.empty(len(whole), np.int64), np.ones(len(whole), np.int64)
        start[whole >= 0] = len(ids) + np.arange((whole >= 0).sum())
        start[whole < 0], size[whole < 0] = starts[:-1], np.diff(starts)
        code = each.indices.to_numpy()
        out, sizes = ragged(np.r_[ids, whole[whole >= 0]], start[code], size[code])
        cuts = np.r_[0, np.cumsum(sizes)][np.cumsum([0, *map(len, split)])]
        return [out[s:e].tolist() for s, e in zip(cuts, cuts[1:])]

    def decode(self, ids: Iterable[int], portion: int = 65_536) -> Iterator[tuple[bytes, str]]:
        """(bytes, complete text) of the ids, portion by portion; the last portion closes the stream."""
        ids, stream = list(ids), Utf8Stream()
        for at in range(0, len(ids), portion):
            data = b"".join(map(self.table.__getitem__, ids[at : at + portion]))
            yield data, stream.feed(data)
        yield b"", stream.close()


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def portions(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts of about a megabyte together and the first one's row. No cycles are made meanwhile."""
    gc.disable()  # else each collection walks all states
    try:
        yield from texts_of(column)
    finally:
        gc.enable()


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every whole text. A null or empty text has no ids; a null key stays null."""

    def run(batches):
        for b in batches:
            c = codec(path)
            for lo, part in portions(b.column(1)):
                ids = pa.array(c.encode_all(part), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(part)), ids], ["key", "ids"])

    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decoded(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text, valid) of every id list by the streaming decoder; null ids give an empty text, unknown ids nothing."""

    def run(batches):
        for b in batches:
            c, texts, valid = codec(path), [], []
            for row in b.column(1).to_pylist():
                known = [i for i in row or [] if i is not None and 0 <= i < len(c.table)]
                out = "".join(t for _, t in c.decode(known))
                texts.append(out)
                valid.append(out.encode() == b"".join(map(c.table.__getitem__, known)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(valid)], ["key", "text", "valid"])

    picked = tokens.select(tokens[key].alias("key"), tokens[ids].alias("ids"))
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, text string, valid boolean").withColumnRenamed("key", key)


def round_trips(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text: number of ids, digest of the ids joined by commas, digest of the bytes that decoding them gives.

    Null and empty texts have no ids and the digests of nothing. Rows are independent: ties, repeated rows and further
    columns change nothing, and an empty table gives an empty result.
    """

    def run(batches):
        for b in batches:
            c = codec(path)
            for lo, part in portions(b.column(1)):
                counts, of_ids, of_bytes = [], [], []
                for ids in c.encode_all(part):
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(map(c.names.__getitem__, ids)).encode()).hexdigest())
                    digest = hashlib.sha256()
                    for _, text_of_ids in c.decode(ids):
                        digest.update(text_of_ids.encode())
                    of_bytes.append(digest.hexdigest())
                columns = [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(part)), *columns], ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return picked.mapInArrow(run, schema).withColumnRenamed("key", key)
