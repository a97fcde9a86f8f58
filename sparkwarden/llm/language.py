"""Language of texts by Bayesian fusion: text likelihoods, declared language, address suffix, smoothed host priors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sparkwarden.llm.common import byte_rows, chunks, frugal, stored

LANGUAGES = ("en", "de", "fr", "es")
#: Label of texts that no language explains.
UNKNOWN = "und"
#: Rows that the text model learns from, in expectation, drawn evenly by a hash of the text.
SAMPLE = 20_000
BUCKETS = 1 << 13
#: Neighbouring trigrams tell much the same: the share of their log likelihood that counts.
TEMPER = 0.2
#: Rows' worth of the parent's prior in a host's prior, of the site's in that, and of unseen values in other counts.
STRENGTH = 20.0
#: Prior share of texts in no known language.
OTHER = 1e-3
CONFIDENCE = 0.5

_CLASS = np.zeros(256, np.uint8)  # letters in lower case; everything else is one space
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = _CLASS[97:123]
_CLASS[128:] = np.arange(128, 256)
_CLASS[_CLASS == 0] = 32


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each trigram around a letter, with the ends of words; all that is not a letter is space."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    letters = _CLASS[data]
    # Capitals of Latin-1 in UTF-8: the second byte after 195.
    capital = np.flatnonzero((data[:-1] == 195) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    letters[capital] |= 0x20
    # A space before and after each text.
    padded = np.full(len(data) + 2 * (len(bounds) - 1), 32, np.uint8)
    own = np.arange(len(data)) + 1 + 2 * text
    padded[own] = letters
    at = own[letters != 32]
    code = (padded[at - 1].astype(np.uint32) << 16) | (padded[at].astype(np.uint32) << 8) | padded[at + 1]
    return text[letters != 32], ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)).astype(np.int64)


def _primary(declared: Column) -> Column:
    """'EN-us' and 'en_GB' count as 'en'; empty is none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(declared)), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def fit(docs: DataFrame, text: str = "text", declared: str = "lang", languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE) -> np.ndarray:
    """Log probabilities (languages x buckets) of trigrams, from about ``sample`` rows by their declared language.

    Counts are summed on the executors; the driver gets one number per language and bucket at most. A language without
    rows has even probabilities.
    """
    known = docs.select(docs[text].cast("string").alias("text"), _primary(docs[declared]).alias("language"))
    known = known.where(F.col("language").isin(*languages) & (F.length("text") > 0))
    total = known.count()
    share = min(1.0, sample / total) if total else 0.0
    drawn = known.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches):
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            data, bounds = byte_rows(b.column(0))
            label = np.array([languages.index(x) for x in b.column(1).to_pylist()], np.int64)
            for lo, hi in chunks(np.diff(bounds), 1 << 18):
                of, bucket = trigrams(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                counts += np.bincount(label[lo + of] * BUCKETS + bucket, minlength=counts.size).reshape(counts.shape)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], ["at", "n"])

    rows = drawn.mapInArrow(frugal(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(languages) * BUCKETS)
    counts[rows["at"].to_numpy()] = rows["n"].to_numpy()
    counts = counts.reshape(len(languages), BUCKETS) + 0.1
    return np.log(counts / counts.sum(1, keepdims=True))


def _likelihoods(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """Replaces ``text`` by ``likely``, log likelihoods per language and, last, of even chances, and ``share``, the
    posteriors by the text alone over the languages. Both are empty without letters."""
    others = [f for f in rows.schema if f.name != "text"]
    n = len(model)

    def run(batches):
        table = np.c_[model.T, np.full(BUCKETS, -np.log(BUCKETS))]
        for b in batches:
            data, bounds = byte_rows(b.column(b.schema.get_field_index("text")))
            for lo, hi in chunks(np.diff(bounds), 1 << 18):
                of, bucket = trigrams(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                sums = np.stack([np.bincount(of, table[bucket, k], minlength=hi - lo) for k in range(n + 1)], 1)
                some = np.bincount(of, minlength=hi - lo) > 0
                share = _softmax(sums[:, :n] * TEMPER)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(f.name).slice(lo, hi - lo) for f in others), _lists(sums, some), _lists(share, some)],
                    [*(f.name for f in others), "likely", "share"],
                )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return rows.mapInArrow(frugal(run), f"{kept}, likely array<double>, share array<double>")


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _lists(rows: np.ndarray, some: np.ndarray) -> pa.Array:
    """The rows as lists, empty where not ``some``."""
    size = np.where(some, rows.shape[1], 0)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(rows[some].ravel()))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    """Lists of n numbers as rows; null and empty lists are zeros."""
    out = np.zeros((len(column), n))
    some = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False) > 0
    out[some] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return out


def _sums(column: str, n: int) -> Column:
    return F.array(*[F.sum(F.coalesce(F.get(column, F.lit(i)), F.lit(0.0))) for i in range(n)])


def identified(
    docs: DataFrame, model: np.ndarray, key: str = "doc_id", text: str = "text", declared: str | None = "lang",
    host: str | None = "source", suffix: str | None = None, languages: tuple[str, ...] = LANGUAGES,
) -> DataFrame:
    """(key, language, confidence, posterior, text_language, accepted) for every row of ``docs``.

    The log posterior of a language is the sum of: the tempered log likelihood of the whole text's trigrams; the log of
    its prior for the host, which is smoothed by that of the host's site (its last two labels) and that by all rows'
    shares, a row's own share taken out; and the logs of how often rows of the language declare this language and have
    this suffix. All shares are sums of the rows' text-only posteriors by grouped aggregation. ``UNKNOWN`` is explained by
    even chances. ``accepted`` rows have a known language with a posterior of ``CONFIDENCE`` or more.

    Null and empty texts and texts without letters have no likelihood: they are ``UNKNOWN``, not accepted, and count
    nowhere. Null or unusual declared values, hosts and suffixes give no evidence. Repeated rows count
    as rows; further columns are ignored; an empty table gives an empty one. Ties go to the first of ``languages``.
    """
    none = F.lit(None).cast("string")
    host_ = F.nullif(F.lower(F.trim(docs[host].cast("string"))), F.lit("")) if host else none
    rows = docs.select(
        docs[key].alias("key"),
        docs[text].cast("string").alias("text"),
        (_primary(docs[declared].cast("string")) if declared else none).alias("declared"),
        host_.alias("host"),
        F.substring_index(host_, ".", -2).alias("site"),
        (F.nullif(F.lower(docs[suffix].cast("string")), F.lit("")) if suffix else none).alias("suffix"),
    )
    n = len(languages)
    rows = stored(_likelihoods(rows, model))
    counted = rows.where(F.size("share") > 0)
    told = counted.agg(
        _sums("share", n).alias("all"),
        *[x for c in ("declared", "suffix") for x in (F.count_distinct(c).alias(f"n_{c}"), _sums_where(c, n).alias(f"all_{c}"))],
    ).first()
    for name in ("host", "site", "declared", "suffix"):
        sums = counted.where(F.col(name).isNotNull()).groupBy(name).agg(_sums("share", n).alias(f"by_{name}"))
        # Written first: of known size, it is broadcast if it is small, and else its join can be split at a common value.
        rows = rows.join(stored(sums), name, "left")
    total = {c: np.array([x or 0.0 for x in told[c]]) for c in ("all", "all_declared", "all_suffix")}
    values = {c: float(told[f"n_{c}"] or 0) + 1 for c in ("declared", "suffix")}
    names = np.array([*languages, UNKNOWN], object)

    def plus(own: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Own sums with ``STRENGTH`` rows of the parent's prior, as shares."""
        own = np.maximum(own, 0)
        return (own + STRENGTH * parent) / (own.sum(1, keepdims=True) + STRENGTH)

    def fuse(batches):
        for b in batches:
            column = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            own, likely = _matrix(column["share"], n), _matrix(column["likely"], n + 1)
            some = own.sum(1) > 0
            by = {c: _matrix(column[f"by_{c}"], n) - own for c in ("host", "site", "declared", "suffix")}
            prior = plus(by["host"], plus(by["site"], plus(total["all"] - own, np.full(own.shape, 1 / n))))
            evidence = np.log(prior)
            for c, different in values.items():
                chance = np.log((np.maximum(by[c], 0) + 1) / (np.maximum(total[f"all_{c}"] - own, 0) + different))
                evidence += np.where(column[c].is_valid().to_numpy(zero_copy_only=False)[:, None], chance, 0)
            known = likely[:, :n] * TEMPER + evidence + np.log1p(-OTHER)
            # The unknown language has no say on hosts and declarations; it is held against the best of these.
            unknown = likely[:, n:] * TEMPER + evidence.max(1, keepdims=True) + np.log(OTHER)
            posterior = _softmax(np.c_[known, unknown])
            best = np.where(some, posterior.argmax(1), n)
            confidence = np.where(some, posterior.max(1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    column["key"], pa.array(names[best], pa.string()), pa.array(confidence), _lists(posterior, some),
                    pa.array(names[np.where(some, own.argmax(1), n)], pa.string()),
                    pa.array((best < n) & (confidence >= CONFIDENCE)),
                ],
                ["key", "language", "confidence", "posterior", "text_language", "accepted"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(
        fuse, f"key {kind}, language string, confidence double, posterior array<double>, text_language string, accepted boolean"
    )
    return out.withColumnRenamed("key", key)


def _sums_where(name: str, n: int) -> Column:
    return F.array(*[F.sum(F.when(F.col(name).isNotNull(), F.get("share", F.lit(i)))) for i in range(n)])


def of_pages(pages: DataFrame) -> DataFrame:
    """Pages as texts: (page_id, text without markup, declared, host, suffix) by column expressions."""
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^<>]*+>", " ")
    host = F.regexp_extract(F.lower(F.coalesce(pages["url"].cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return pages.select(
        "page_id",
        F.regexp_replace(text, r"&#?\w{1,12};", " ").alias("text"),
        F.regexp_extract(html, r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3}(?:[-_]\w+)*)", 1).alias("declared"),
        host.alias("host"),
        F.substring_index(host, ".", -1).alias("suffix"),
    )
