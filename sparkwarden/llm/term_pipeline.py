"""Ranked lexical search by pipelined term owners.

Terms belong to owners, the rarest to the first. Bundles of items pass from owner to owner: a cogroup of a bundle's sparse
accumulators, one score per document, with the postings of the owner's terms adds whole numbers to them. Documents lie in
slices of bounded size, numbered where they are read, and a bundle meets a slice at a time, so that no group grows with the input.
An accumulator goes when even the largest contributions still ahead can't lift it to the score that an item's k-th best document
has already; this never changes the result.
"""

from __future__ import annotations

from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkwarden.llm.common import chunks, stored

#: Documents of a slice and postings after which it ends sooner; items of a bundle.
SLICE, POSTINGS, BUNDLE = 4096, 1 << 20, 256
#: Bits of the filter that spares postings of terms in no item; the filter is the only thing of the items that tasks get whole.
BITS = 1 << 22
#: Words whose hash a task remembers.
WORDS = 1 << 19
#: The last owner has the terms that over one document in RATIO holds, the one before it those over one in RATIO squared, ...
OWNERS, RATIO = 4, 4

_FOLDED = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
_INDEX = (
    "slice long, term long, places binary, counts binary, top long, least long, ids array<bigint>, lengths binary, n_docs long, n_terms long"
)
_STATE = "slice long, bundle int, item long, places binary, scores binary"


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII, in UTF-8; only A-Z are lower-cased."""
    return text.translate(_FOLDED).split()


def term_hash(term: bytes) -> int:
    """Terms are told apart by 64 bits; the value is that of Spark's ``xxhash64``."""
    h = xxhash.xxh64_intdigest(term, 42)
    return h - (1 << 64) if h >> 63 else h


def _text_rows(column: pa.Array):
    """(first row, texts in bytes) in portions of about a megabyte."""
    for lo, hi in chunks(pc.fill_null(pc.binary_length(column), 0).to_numpy(), 1 << 20):
        yield lo, [x or b"" for x in column.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, term): the distinct terms of each item."""

    def run(batches):
        for b in batches:
            for lo, texts in _text_rows(b.column(1)):
                sets = [[term_hash(t) for t in set(terms_of(x))] for x in texts]
                sizes = pa.array([len(s) for s in sets], pa.int64())
                rows = np.repeat(np.arange(lo, lo + len(texts)), sizes)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array([h for s in sets for h in s], pa.int64())], ["item", "term"]
                )

    return items.mapInArrow(run, "item long, term long").distinct()


def _filter(terms: DataFrame) -> np.ndarray:
    """A bit per remainder of the items' terms: BITS bits however many items there are."""
    n = F.pmod("term", F.lit(BITS)) + 1
    rows = terms.groupBy(F.bitmap_bucket_number(n).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits"))
    out = np.zeros((BITS >> 15, 1 << 12), np.uint8)
    for r in rows.collect():
        out[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _indexed(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Slices of documents: a row for each term with its documents' places and counts, and a row (null term) for the slice itself."""

    def run(batches):
        base, number = TaskContext.get().partitionId() << 32, 0
        known: dict[bytes, int | None] = {}
        ids: list[int | None] = []
        lengths, places, terms, counts = array("q"), array("i"), array("q"), array("q")

        def hash_of(t: bytes) -> int | None:
            if len(known) >= WORDS:
                known.clear()
            h = term_hash(t)
            n = h % BITS
            known[t] = h = h if bits[n >> 3] >> (n & 7) & 1 else None
            return h

        def closed():
            t, p, c = np.array(terms), np.array(places), np.array(counts)
            n = np.array(lengths)
            order = np.argsort(t, kind="stable")
            t, p, c = t[order], p[order], c[order]
            starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(t)] if len(t) else starts
            raw_p, raw_c = p.astype("<i4").tobytes(), c.astype("<i8").tobytes()
            some = len(starts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([base + number] * (some + 1), pa.int64()),
                    pa.array([*t[starts].tolist(), None], pa.int64()),
                    pa.array([*(raw_p[4 * s : 4 * e] for s, e in zip(starts, ends)), None], pa.binary()),
                    pa.array([*(raw_c[8 * s : 8 * e] for s, e in zip(starts, ends)), None], pa.binary()),
                    pa.array([*(np.maximum.reduceat(c, starts).tolist() if some else []), None], pa.int64()),
                    pa.array([*(np.minimum.reduceat(n[p], starts).tolist() if some else []), None], pa.int64()),
                    pa.array([*[None] * some, ids], pa.list_(pa.int64())),
                    pa.array([*[None] * some, n.astype("<i8").tobytes()], pa.binary()),
                    pa.array([*(ends - starts).tolist(), int((n > 0).sum())], pa.int64()),
                    pa.array([*[None] * some, int(n.sum())], pa.int64()),
                ],
                [f.split()[0] for f in _INDEX.split(", ")],
            )

        for b in batches:
            for lo, texts in _text_rows(b.column(1)):
                for key, text in zip(b.column(0).slice(lo, len(texts)).to_pylist(), texts):
                    words = terms_of(text)
                    for term, count in Counter(words).items():
                        h = known[term] if term in known else hash_of(term)
                        if h is not None:
                            places.append(len(ids))
                            terms.append(h)
                            counts.append(count)
                    ids.append(key)
                    lengths.append(len(words))
                    if len(ids) >= SLICE or len(terms) >= POSTINGS:
                        yield from closed()
                        number, ids = number + 1, []
                        del lengths[:], places[:], terms[:], counts[:]
        if ids:
            yield from closed()

    return docs.mapInArrow(run, _INDEX)


def _share(counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 20 * norms)


def _norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 50 + (50 * lengths * n_docs) // max(n_terms, 1)


def _weighed(terms: DataFrame, index: DataFrame, n_docs: int, n_terms: int, owners: int) -> DataFrame:
    """(item, term, owner, weight, ahead): ``ahead`` is the most that an item's later owners can add to a document."""
    spread = index.where("term IS NOT NULL").groupBy("term").agg(F.sum("n_docs").alias("df"), F.max("top").alias("top"), F.min("least").alias("least"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    norm = F.expr(f"50 + (50 * least * {n_docs}L) div {max(n_terms, 1)}L")
    most = F.col("weight") * F.expr("(1000000000 * top) div (1000 * top + 20 * norm)")
    owner = sum((F.col("df") * RATIO**k > n_docs).cast("int") for k in range(1, owners))
    rows = terms.join(spread.withColumn("weight", weight).withColumn("norm", norm).withColumn("owner", owner), "term").where("weight > 0")
    own = Window.partitionBy("item")
    later = [F.coalesce(F.sum(F.when(F.col("owner") > s, F.col("most"))).over(own), F.lit(0)) for s in range(owners)]
    rows = rows.withColumn("most", most).withColumn("later", F.array(*later))
    return rows.select("item", "term", "owner", "weight", F.get("later", F.col("owner")).alias("ahead"))


def _stage(k: int, n_docs: int, n_terms: int, last: bool):
    """What an owner does with a bundle at a slice."""

    def run(key: tuple, bundle: pa.Table, own: pa.Table) -> pa.Table:
        own_rows, state = own.to_pylist(), bundle.to_pylist()
        lengths = next(r["lengths"] for r in own_rows if r["term"] is None)
        ids = next(r["ids"] for r in own_rows if r["term"] is None)
        least = {x["item"]: x["score"] for r in own_rows if r["term"] is None for x in r["thresholds"] or []}
        norms = _norms(np.frombuffer(lengths, "<i8"), n_docs, n_terms)
        scores: dict[int | None, np.ndarray] = {}
        ahead: dict[int | None, int] = {}
        for r in state:
            scores[r["item"]] = row = np.zeros(len(norms), np.int64)
            row[np.frombuffer(r["places"], "<i4")] = np.frombuffer(r["scores"], "<i8")
        for r in own_rows:
            if r["term"] is not None:
                at = np.frombuffer(r["places"], "<i4")
                share = _share(np.frombuffer(r["counts"], "<i8"), norms[at])
                for x in r["users"]:
                    if x["item"] not in scores:
                        scores[x["item"]] = np.zeros(len(norms), np.int64)
                    ahead[x["item"]] = x["ahead"]
                    scores[x["item"]][at] += x["weight"] * share
        out = []
        for item, row in scores.items():
            at = np.flatnonzero(row)
            found = row[at]
            if last or item in ahead:
                bound = least.get(item, 1)
                if len(found) > k:
                    bound = max(bound, int(np.partition(found, -k)[-k]))
                keep = found + (0 if last else ahead[item]) >= bound
                at, found = at[keep], found[keep]
            out.append((item, at, found))
        if last:
            best = [(item, ids[p], s) for item, at, found in out for s, p in _best(at, found, ids, k)]
            items, docs, values = zip(*best) if best else ((), (), ())
            return pa.table({"item": pa.array(items, pa.int64()), "doc_id": pa.array(docs, pa.int64()), "score": pa.array(values, pa.int64())})
        out = [(i, a, s) for i, a, s in out if len(a)]
        return pa.table(
            {
                "slice": pa.array([key[0].as_py()] * len(out), pa.int64()), "bundle": pa.array([key[1].as_py()] * len(out), pa.int32()),
                "item": pa.array([i for i, *_ in out], pa.int64()),
                "places": pa.array([a.astype("<i4").tobytes() for _, a, _ in out], pa.binary()),
                "scores": pa.array([s.astype("<i8").tobytes() for *_, s in out], pa.binary()),
            }
        )

    return run


def _best(at: np.ndarray, found: np.ndarray, ids: list, k: int) -> list[tuple[int, int]]:
    """(score, place) of the k best, equal scores by id, rows without id last."""
    rows = zip(found.tolist(), at.tolist())
    return sorted(rows, key=lambda r: (-r[0], ids[r[1]] is None, ids[r[1]] or 0))[:k]


def _thresholds(state: DataFrame, k: int) -> DataFrame:
    """(bundle, thresholds): the k-th best score so far of each item that has as many documents."""

    def run(batches):
        for b in batches:
            for bundle, item, scores in zip(*(b.column(i).to_pylist() for i in range(3))):
                top = np.sort(np.frombuffer(scores, "<i8"))[-k:]
                columns = [pa.array([bundle] * len(top), pa.int32()), pa.array([item] * len(top), pa.int64()), pa.array(top)]
                yield pa.RecordBatch.from_arrays(columns, ["bundle", "item", "score"])

    rows = state.select("bundle", "item", "scores").mapInArrow(run, "bundle int, item long, score long")
    place = F.row_number().over(Window.partitionBy("bundle", "item").orderBy(F.desc("score")))
    rows = rows.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k)
    return rows.groupBy("bundle").agg(F.collect_list(F.struct("item", "score")).alias("thresholds"))


def _bundle(item: Column, bundles: int) -> Column:
    return F.pmod(F.xxhash64(item, F.lit(11)), F.lit(bundles)).cast("int")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 50, owners: int = OWNERS,
    key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` highest-scoring rows of ``docs`` for each item, scores above 0 only.

    A document's score sums, over the item's distinct terms, weight * (10^9 tf div (1000 tf + 20 m)) in 64-bit integers, with
    the weight floor(1000 ln((2 N + 2) / (2 df + 1))) and the length norm m = 50 + 50 n N div L. Null and empty texts have no terms;
    such documents count nowhere, such items have no rows. Equal scores are ranked by ascending id, rows without id last.
    Every row is a document of its own, also with a repeated id; rows of one item id, or of none, are one item with the terms of all. Further
    columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    asked = items.select(items[item].cast("long").alias("item"), items[item_text].cast("string").alias("text"))
    terms = stored(_item_terms(asked))
    picked = docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    index = stored(_indexed(picked, _filter(terms)))
    n_docs, n_terms = (int(x or 0) for x in index.where("term IS NULL").agg(F.sum("n_docs"), F.sum("n_terms")).first())
    bundles = max(1, -(-terms.select("item").distinct().count() // BUNDLE))
    weighed = _weighed(terms, index, n_docs, n_terms, owners).withColumn("bundle", _bundle(F.col("item"), bundles))
    users = weighed.groupBy("term", "bundle", "owner").agg(F.collect_list(F.struct("item", "weight", "ahead")).alias("users"))
    postings = stored(index.select("slice", "term", "places", "counts").join(stored(users), "term"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle")
    slices = index.where("term IS NULL").select("slice", numbers, "ids", "lengths")
    state = spark.createDataFrame([], _STATE)
    empty = "cast(NULL AS array<struct<item:bigint,score:bigint>>)"
    for n in range(owners):
        last = n == owners - 1
        heads = slices.withColumn("thresholds", F.expr(empty)) if n == 0 else slices.join(stored(_thresholds(state, k)), "bundle", "left")
        own = postings.where(F.col("owner") == n).drop("owner").unionByName(heads, allowMissingColumns=True)
        meet = state.groupBy("slice", "bundle").cogroup(own.groupBy("slice", "bundle"))
        schema = "item long, doc_id long, score long" if last else _STATE
        state = stored(meet.applyInArrow(_stage(k, n_docs, n_terms, last), schema))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return state.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
