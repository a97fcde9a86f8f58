"""SentencePiece BPE by a table of the last token of every prefix, and its decoder.

Merging always joins the neighbours whose joint piece has the best score, the leftmost first among equals. What it makes of a
prefix ends in one token only: of the tokens that an automaton finds to end there, it is the one that stays apart from the
last token of the prefix before it. One pass over the text fills the table, and the ids are read off backwards.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkwarden.llm.common import texts_of

SPACE = "▁"
#: Fixed value: what the library writes for the unknown id.
UNKNOWN = " ⁇ "
#: Words whose ids, and pairs of tokens whose compatibility a worker remembers; a full store starts anew.
WORDS, PAIRS = 300_000, 1 << 20


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("each_byte", _each_byte)


class Table:
    """Tokens with their merges, best score first; single characters are tokens from the start.

    ``scores`` has (piece, score) of all pieces that merging may make. A piece that merging does not make of its own text
    takes no part. Pieces must come after those they are merged of, as training gives them; others raise an error.
    """

    def __init__(self, scores: Iterable[tuple[str, float]]):
        scores = sorted(scores, key=lambda s: (-s[1], len(s[0]), s[0]))
        self.text: list[str] = sorted({c for piece, _ in scores for c in piece})
        self.number = {c: i for i, c in enumerate(self.text)}
        n = len(self.text)
        self.left, self.right, self.rank = [-1] * n, [-1] * n, [-1] * n
        self.joined: dict[tuple[int, int], int] = {}
        lost, rank, before = [], -1, None
        for piece, score in scores:
            if score != before:
                rank, before = rank + 1, score
            if len(piece) > 1 and not self._add(piece, rank):
                lost.append(piece)
        self._complete()
        self._known: dict[int, bool] = {}
        self.size = [len(piece) for piece in self.text]
        self.automaton = ahocorasick.Automaton()
        for t, piece in enumerate(self.text):
            self.automaton.add_word(piece, t)
        if self.text:
            self.automaton.make_automaton()
        # With all merges known, a lost piece must still be lost.
        for piece in lost:
            if merged(piece, dict(scores)) == [piece]:
                raise ValueError(f"piece {piece!r} comes before those that it is merged of")

    def _add(self, piece: str, rank: int) -> bool:
        """Makes the piece a token if some two earlier tokens, apart until now, give it."""
        number = self.number
        for at in range(1, len(piece)):
            a, b = number.get(piece[:at]), number.get(piece[at:])
            if a is not None and b is not None and self._apart(a, b):
                number[piece] = len(self.text)
                self.text.append(piece)
                self.left.append(a)
                self.right.append(b)
                self.rank.append(rank)
                self._pairs_of(number[piece])
                return True
        return False

    def _pairs_of(self, t: int) -> None:
        """Any two tokens whose texts make the piece may be joined to it."""
        piece, number = self.text[t], self.number
        for at in range(1, len(piece)):
            a, b = number.get(piece[:at]), number.get(piece[at:])
            if a is not None and b is not None:
                self.joined[a, b] = t

    def _complete(self) -> None:
        """Pairs whose parts became tokens after the piece that they make."""
        for t in range(len(self.text)):
            self._pairs_of(t)

    def _apart(self, a: int, b: int) -> bool:
        """True if merging leaves a border between the tokens a and b, one after the other.

        Their merges are undone, the last one first (among equals the right one is later), and at each step the two parts at
        the border must not have been joined before the merge that was undone.
        """
        joined, rank = self.joined, self.rank
        if (a, b) in joined:
            return False
        while rank[a] >= 0 or rank[b] >= 0:
            if rank[b] >= rank[a]:
                undone, b = rank[b], self.left[b]
                both = joined.get((a, b))
                if both is not None and rank[both] <= undone:
                    return False
            else:
                undone, a = rank[a], self.right[a]
                both = joined.get((a, b))
                if both is not None and rank[both] < undone:
                    return False
        return True

    def last_tokens(self, text: str) -> list[int]:
        """The last token of every prefix; -1 for a character that is in no piece."""
        last = [-1] * len(text)
        if not self.text:
            return last
        known, size, n = self._known, self.size, len(self.text)
        for end, t in self.automaton.iter(text):
            if last[end] < 0:
                before = end - size[t]
                one = last[before] if before >= 0 else -1
                if one < 0:
                    last[end] = t
                    continue
                apart = known.get(one * n + t)
                if apart is None:
                    if len(known) >= PAIRS:
                        known.clear()
                    apart = known[one * n + t] = self._apart(one, t)
                if apart:
                    last[end] = t
        return last

    def walk(self, text: str) -> list[int]:
        """The numbers of the tokens of a text, read backwards from the table; -1 - code point for characters in no piece."""
        last, out, end, size = self.last_tokens(text), [], len(text), self.size
        while end:
            t = last[end - 1]
            if t < 0:
                end -= 1
                t = -1 - ord(text[end])
            else:
                end -= size[t]
            out.append(t)
        out.reverse()
        return out

    def tokens(self, text: str) -> list[str]:
        return [self.text[t] if t >= 0 else chr(-1 - t) for t in self.walk(text)]


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """The tokens of a short text by merging step after step."""
    parts = list(text)
    while True:
        best, place = None, -1
        for i in range(len(parts) - 1):
            score = scores.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best):
                best, place = score, i
        if best is None:
            return parts
        parts[place : place + 2] = [parts[place] + parts[place + 1]]


class _Words(dict):
    """Ids of words as bytes, worked out when asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= 64:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Encoder and decoder of a model file: BPE with byte fallback and without a character map; others raise an error."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds, norm = model.SentencePiece, model.normalizer_spec
        usual = norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback or not usual:
            raise ValueError("only BPE models with byte fallback, escaped white space and no character map")
        pieces = [(p.piece, p.score, p.type) for p in model.pieces]
        if any(kind in (kinds.USER_DEFINED, kinds.UNUSED) for *_, kind in pieces):
            raise ValueError("models with user-defined or unused pieces are not read")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.begin, self.end = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        normal = [(piece, score) for piece, score, kind in pieces if kind == kinds.NORMAL]
        self.table = Table(normal)
        ids = {piece: i for i, (piece, _, kind) in enumerate(pieces) if kind == kinds.NORMAL}
        self.bytes = {int(piece[1:-1], 16): i for i, (piece, _, kind) in enumerate(pieces) if kind == kinds.BYTE}
        self.plain, self.opens = [], []
        for piece, _, kind in pieces:
            if kind == kinds.BYTE:
                out = bytes([int(piece[1:-1], 16)])
            elif kind == kinds.CONTROL:
                out = b""
            else:
                out = (UNKNOWN if kind == kinds.UNKNOWN else piece.replace(SPACE, " ")).encode()
            self.plain.append(out)
            self.opens.append(kind == kinds.NORMAL and piece.startswith(SPACE))
        # No piece has white space after something else: then texts fall apart before white space.
        cut = all(SPACE not in piece.lstrip(SPACE) for piece, _ in normal)
        self.parts = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if cut else r"(?s:.+)").findall
        self.packed_token = [
            self._packed([ids[piece]]) if piece in ids else self._in_bytes(piece) for piece in self.table.text
        ]
        self.words = _Words(self._word)
        self.first, self.last = self._packed([self.begin]), self._packed([self.end])

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def _in_bytes(self, c: str) -> bytes:
        return self._packed([self.bytes[b] for b in c.encode()])

    def _word(self, word: str) -> bytes:
        packed = self.packed_token
        return b"".join([packed[t] if t >= 0 else self._in_bytes(chr(-1 - t)) for t in self.table.walk(word)])

    def packed(self, text: str) -> bytes:
        """Ids of a whole text, begin and end included, as little-endian unsigned 32-bit integers."""
        if text:
            text = self.prefix + text.replace(" ", SPACE)
        return b"".join([self.first, *map(self.words.__getitem__, self.parts(text)), self.last])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids are silent, the space before the text goes, each stray byte becomes U+FFFD.

        Ids that the model has not raise an error, as with the library.
        """
        plain = self.plain
        if ids and min(ids) < 0:
            raise IndexError("piece id is out of range")
        data = b"".join(map(plain.__getitem__, ids))
        if self.prefix and self.opens[next((i for i in ids if plain[i]), 0)]:
            data = data[1:]
        return data.decode("utf-8", "each_byte")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _mapped(rows: DataFrame, key: str, column: str, schema: str, read) -> DataFrame:
    """``read`` on portions of a column, beside the key."""

    def run(batches):
        for b in batches:
            for lo, n, columns in read(b.column(1)):
                names = [f.split()[0] for f in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), *columns], ["key", *names])

    picked = rows.select(rows[key].alias("key"), rows[column].alias("value"))
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every whole text with begin and end ids. A null text is read as empty; a null key stays null."""

    def read(column):
        for lo, part in texts_of(column):
            yield lo, len(part), [pa.array([codec(path).encode(t) for t in part], pa.list_(pa.int32()))]

    return _mapped(docs, key, text, "ids array<int>", read)


def decoded(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every list of ids; null and empty lists give an empty text, null ids in a list are passed over."""

    def read(column):
        texts = [codec(path).decode([i for i in row or [] if i is not None]) for row in column.to_pylist()]
        yield 0, len(texts), [pa.array(texts, pa.string())]

    return _mapped(tokens, key, ids, "text string", read)


def round_trips(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text: number of ids, digest of the packed ids, digest of the text that decoding them gives.

    Null and empty texts have the begin and end ids only and the digest of nothing. Rows are independent: ties, repeated
    rows and further columns change nothing, a null key stays null, and an empty table gives an empty result. Time is
    linear in a text's length, also where it has no white space.
    """

    def read(column):
        c = codec(path)
        for lo, part in texts_of(column):
            counts, of_ids, of_text = [], [], []
            for t in part:
                ids = c.packed(t)
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(c.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
            yield lo, len(part), [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]

    return _mapped(docs, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", read)
