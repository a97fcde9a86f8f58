"""Passages of known prompts in files, whatever their spacing, punctuation and case.

Texts are compared by their letters and digits alone. From every window of neighbouring hashes the smallest is a fingerprint, so that
any shared passage of the guaranteed length shares one. Fingerprints meet in an equi join; only files with a fingerprint of a prompt have
their text joined, and spans are then found on the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkwarden.session import stored

VERIFIER = "prompt-leak"
DESCRIPTION = "Passages of known prompts in files"
RULE, SEVERITY = "prompt-leak.passage", "high"

#: Characters of a hash, and hashes of a window: passages of GRAM + WINDOW - 1 letters and digits are found for sure.
GRAM, WINDOW = 20, 21
GUARANTEE = GRAM + WINDOW - 1
#: Bits of the filter that spares other fingerprints; its size does not depend on the prompts.
BITS = 1 << 24


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ASCII letters (as small ones), digits and all characters beyond ASCII, and their places in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = (codes >= 65) & (codes <= 90)
    kept = upper | ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57)) | (codes >= 128)
    places = np.flatnonzero(kept)
    return np.where(upper, codes + 32, codes)[places], places


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def fingerprints(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places): of every window of WINDOW hashes of GRAM characters the smallest, the last one among equals."""
    n = len(codes) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.zeros(n, np.uint64)
    for j in range(GRAM):
        hashes = hashes * np.uint64(0x100000001B3) + codes[j : j + n].astype(np.uint64)
    hashes = _mixed(hashes)
    found, step = [], 1 << 18
    for at in range(0, n - WINDOW + 1, step):
        windows = np.lib.stride_tricks.sliding_window_view(hashes[at : at + step + WINDOW - 1], WINDOW)
        found.append(at + np.arange(len(windows)) + WINDOW - 1 - windows[:, ::-1].argmin(1))
    places = np.unique(np.concatenate(found))
    return hashes[places].view(np.int64), places


def shared_spans(one: np.ndarray, other: np.ndarray, least: int = GUARANTEE) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of ``one`` that common passages of ``least`` characters or more cover.

    Each pair of equal fingerprints names a shift between the texts, which is then compared throughout.
    """
    hashes, places = fingerprints(one)
    others, at = fingerprints(other)
    order = np.argsort(others, kind="stable")
    others, at = others[order], at[order]
    low, high = np.searchsorted(others, hashes, "left"), np.searchsorted(others, hashes, "right")
    shifts = {int(p) - int(q) for p, s, e in zip(places, low, high) for q in at[s:e]}
    edges = np.zeros(len(one) + 1, np.int64)
    for shift in shifts:
        begin, end = max(0, shift), min(len(one), len(other) + shift)
        same = np.r_[False, one[begin:end] == other[begin - shift : end - shift], False]
        turns = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(turns[::2], turns[1::2]):
            if e - s >= least:
                edges[begin + s] += 1
                edges[begin + e] -= 1
    covered = np.r_[False, np.cumsum(edges)[:-1] > 0, False]
    turns = np.flatnonzero(covered[1:] != covered[:-1])
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def _hashed(rows: DataFrame, keys: list[str], text: str, bits: np.ndarray | None = None) -> DataFrame:
    """Distinct (keys, hash) of each row's fingerprints, with a filter only those that it holds."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                hashes = np.unique(fingerprints(letters(b.column(len(keys))[i].as_py() or "")[0])[0])
                if bits is not None:
                    n = (hashes & (BITS - 1)).astype(np.int64)
                    hashes = hashes[(bits[n >> 3] >> (n & 7).astype(np.uint8)) & 1 > 0]
                if len(hashes):
                    own = [b.column(c).slice(i, 1).take(pa.array(np.zeros(len(hashes), np.int64))) for c in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(hashes)], [*keys, "hash"])

    return rows.select(*keys, text).mapInArrow(run, f"{kinds}, hash long")


def _filter(hashes: DataFrame) -> np.ndarray:
    """A bit per remainder of the hashes, BITS in all."""
    n = F.pmod("hash", F.lit(BITS)) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(n).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits"))
    out = np.zeros((BITS >> 15, 1 << 12), np.uint8)
    for r in rows.collect():
        out[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def prompt_leaks(files: DataFrame, prompts: DataFrame) -> DataFrame:
    """Passages of ``prompts(prompt_id, text)`` of GUARANTEE letters and digits or more in files, as maximal runs per prompt.

    ``repo, path, prompt_id, norm_start, length`` count letters and digits; ``start, end, start_line, end_line`` are places in the
    file (offsets from 0, lines from 1, end exclusive). Null texts and shorter ones hold nothing; repeated rows count once. A fingerprint that very many
    files hold, or very many prompts, is one key of an equi join of two written tables, which adaptive execution splits.
    """
    kept = prompts.select("prompt_id", F.col("text").alias("prompt")).where("prompt IS NOT NULL").distinct()
    known = stored(_hashed(kept, ["prompt_id"], "prompt").distinct())
    found = stored(_hashed(files, ["repo", "path"], "content", _filter(known)))
    pairs = stored(found.join(known, "hash").select("repo", "path", "prompt_id").distinct())
    holding = files.select("repo", "path", "content").join(pairs.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    rows = holding.join(pairs, ["repo", "path"]).join(kept, "prompt_id").select("repo", "path", "prompt_id", "content", "prompt")
    names = ["repo", "path", "prompt_id", "norm_start", "length", "start", "end", "start_line", "end_line"]
    kind = prompts.schema["prompt_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(3)[i].as_py()
                codes, places = letters(text)
                spans = shared_spans(codes, letters(b.column(4)[i].as_py())[0])
                if spans:
                    own = [b.column(c).slice(i, 1).take(pa.array([0] * len(spans))) for c in range(3)]
                    s, e = (np.array(x) for x in zip(*spans))
                    begin, end = places[s], places[e - 1] + 1
                    breaks = np.array([m for m, c in enumerate(text) if c == "\n"], np.int64)
                    lines = [np.searchsorted(breaks, x) + 1 for x in (begin, end - 1)]
                    numbers = [pa.array(x.astype(np.int32)) for x in (s, e - s, begin, end, *lines)]
                    yield pa.RecordBatch.from_arrays([*own, *numbers], names)

    schema = f"repo string, path string, prompt_id {kind}, norm_start int, length int, start int, end int, start_line int, end_line int"
    leaks = rows.mapInArrow(run, schema).distinct()
    return leaks.select("*", F.lit(VERIFIER).alias("verifier_id"), F.lit(RULE).alias("rule_id"), F.lit(SEVERITY).alias("severity"))
