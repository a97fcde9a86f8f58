"""Toxicity of whole texts by a logistic classifier that is held to equal scores under swapped identity terms."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkwarden.llm.common import frugal, stored, texts_of

#: Labelled rows that training takes at most in expectation, drawn evenly by a hash of the id.
SAMPLE = 12_000
THRESHOLD = 0.3
#: Beginnings of words that are features beside whole words, so that unseen inflections share them.
STEMS = (4, 5, 6)
#: Terms that name groups of people, by language. Swapping one for another of its language must not change a score.
IDENTITIES = {
    "en": "women men girls boys muslims christians jews hindus buddhists atheists blacks whites asians africans europeans "
    "americans arabs immigrants refugees foreigners gays lesbians transgender straight disabled blind deaf elderly young "
    "muslim christian jewish black white asian african gay lesbian woman man girl boy",
    "de": "frauen männer mädchen jungen muslime christen juden schwarze weiße asiaten afrikaner europäer araber migranten "
    "flüchtlinge ausländer schwule lesben behinderte blinde gehörlose alte junge",
    "fr": "femmes hommes filles garçons musulmans chrétiens juifs noirs blancs asiatiques africains européens arabes "
    "immigrés réfugiés étrangers homosexuels lesbiennes handicapés aveugles sourds vieux jeunes",
    "es": "mujeres hombres niñas niños musulmanes cristianos judíos negros blancos asiáticos africanos europeos árabes "
    "inmigrantes refugiados extranjeros gais lesbianas discapacitados ciegos sordos ancianos jóvenes",
}
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    """Different words of a text: runs of letters in lower case, so that marks between and around words don't matter."""
    return set(_WORD.findall(text.lower()))


def word_features(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in STEMS if len(word) >= n)]


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def of_word(self, word: str) -> tuple[str, ...]:
        return tuple(f for f in word_features(word) if f in self.weights)

    def score(self, found: set[str], memo: dict[str, tuple[str, ...]]) -> float:
        present: set[str] = set()
        for w in found:
            known = memo.get(w)
            if known is None:
                if len(memo) > 100_000:
                    memo.clear()
                known = memo[w] = self.of_word(w)
            if known:
                present.update(known)
        x = self.bias + sum(self.weights[f] for f in sorted(present))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def swaps(found: set[str]) -> tuple[set[str], set[str]]:
    """A counterfactual of a text's words: (taken out, put in).

    Every identity term is swapped for another of its language. A text without any gets a neutral mention of one. Which
    one, the words decide.
    """
    draw = np.random.default_rng(zlib.crc32(" ".join(sorted(found)).encode()))
    out, into = set(), set()
    for terms in _TERMS:
        for t in sorted(found & terms.keys()):
            out.add(t)
            into.add(list(terms)[int(draw.integers(len(terms)))])
    if not out:
        terms = list(_TERMS[int(draw.integers(len(_TERMS)))])
        into.add(terms[int(draw.integers(len(terms)))])
    return out - into, into - out


_TERMS = [dict.fromkeys(t.split()) for t in IDENTITIES.values()]


def features(found: set[str]) -> set[str]:
    return {f for w in found for f in word_features(w)}


def choose(counts: list[tuple[str, int, int]], rows: int, toxic: int) -> list[str]:
    """Features worth a weight: of (feature, rows with it, toxic rows with it), those whose share of toxic rows differs
    from that of all rows beyond chance (chi-square 12), and those of identity terms, whose effect must be held at zero."""
    share = toxic / rows
    telling = {f for f, n, t in counts if (t - n * share) ** 2 >= 12 * n * share * (1 - share)}
    return sorted(telling | {f for terms in _TERMS for t in terms for f in word_features(t)})


def train(
    known: list[str], present: list[np.ndarray], changes: list[np.ndarray], labels: np.ndarray,
    evenness: float = 20.0, ridge: float = 0.5, rounds: int = 250,
) -> Model:
    """Logistic regression on the presence of the known features, by Adam.

    ``present`` are each row's feature numbers; ``changes`` those that its counterfactual puts in and, as -1 - number,
    takes out. The loss is the log loss, plus ``ridge`` times the squared weights, plus ``evenness`` times the squared
    change of the score between a row and its counterfactual.
    """
    n, k = len(labels), len(known)
    flat = lambda rows: (np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64))
    (row, column), (p_row, change) = flat(present), flat(changes)
    p_sign, p_column = np.where(change < 0, -1.0, 1.0), np.where(change < 0, -1 - change, change)
    share = labels.mean()
    w, bias = np.zeros(k), math.log(share / (1 - share))
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, rounds + 1):
        score = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[column], minlength=n), -500, 500)))
        moved = np.bincount(p_row, p_sign * w[p_column], minlength=n)
        error = score - labels
        slope = np.bincount(column, error[row], minlength=k) + ridge * w
        slope += 2 * evenness * np.bincount(p_column, p_sign * moved[p_row], minlength=k)
        slope = np.r_[slope, error.sum()]
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(float(bias), {f: float(x) for f, x in zip(known, w) if abs(x) > 1e-3})


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from about ``sample`` labelled rows outside ``held_out``, drawn evenly by a hash of the id.

    Of a repeated label the largest counts; null labels and ids are left out. Executors reduce texts to words and count
    features; the driver gets the telling features and, for each row of the sample, their numbers. Without rows of both
    labels the score is a constant.
    """
    known = labels.where(labels[label].isNotNull() & labels[key].isNotNull() & ~held_out(labels[key]))
    known = known.groupBy(labels[key].alias("key")).agg(F.max(labels[label]).alias("label"))
    total = known.count()
    share = min(1.0, sample / total) if total else 0.0
    drawn = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def reduce(batches):
        for b in batches:
            found = [" ".join(sorted(words(t))) for _, part in texts_of(b.column(0)) for t in part]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), b.column(1)], ["words", "label"])

    def count(batches):
        seen, among = Counter(), Counter()
        for b in batches:
            for found, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = features(set(found.split()))
                seen.update(own)
                among.update(own if y else ())
        names = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([seen[f] for f in names], pa.int64()), pa.array([among[f] for f in names], pa.int64())],
            ["feature", "n", "toxic"],
        )

    picked = docs.select(docs[key].alias("key"), docs[text].alias("text")).join(drawn, "key")
    picked = picked.select("text", (F.col("label") > 0).cast("int").alias("label"))
    rows = stored(picked.mapInArrow(frugal(reduce), "words string, label int"))
    told = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    size, toxic = told[0], told[1] or 0
    if not toxic or toxic == size:
        return Model(4.0 if toxic else -4.0, {})
    counts = rows.mapInArrow(frugal(count), "feature string, n long, toxic long").groupBy("feature")
    counts = counts.agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where("n >= 4")
    share = toxic / size
    # The same test as in ``choose``, so that only features that pass travel.
    counts = counts.where(F.pow(F.col("toxic") - F.col("n") * share, 2) >= 12 * F.col("n") * share * (1 - share))
    known = choose([tuple(r) for r in counts.collect()], size, toxic)
    number = {f: i for i, f in enumerate(known)}

    def numbered(batches):
        for b in batches:
            present, changes = [], []
            for found in b.column(0).to_pylist():
                before = set(found.split())
                out, into = swaps(before)
                old, new = features(before), features((before - out) | into)
                present.append(sorted(number[f] for f in old if f in number))
                changes.append(
                    sorted([number[f] for f in new - old if f in number] + [-1 - number[f] for f in old - new if f in number])
                )
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(present, kind), pa.array(changes, kind), b.column(1)], ["present", "changes", "label"])

    data = rows.mapInArrow(frugal(numbered), "present array<int>, changes array<int>, label int").toArrow()
    # In an order of their own, so that sums come out the same however the rows were dealt.
    data = sorted(zip(data["label"].to_pylist(), data["present"].to_pylist(), data["changes"].to_pylist()))
    labels, present, changes = zip(*data)
    arrays = lambda lists: [np.array(x, np.int64) for x in lists]
    return train(known, arrays(present), arrays(changes), np.array(labels, float))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every whole text; null and empty texts have the score of no words.

    Only the text enters a score. Rows are independent: repeated rows and further columns change nothing. A null key is
    not held out.
    """

    def run(batches):
        memo: dict[str, tuple[str, ...]] = {}
        for b in batches:
            scores = np.array([model.score(words(t), memo) for _, part in texts_of(b.column(1)) for t in part], float)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                ["key", "held_out", "score", "predicted"],
            )

    out = F.coalesce(held_out(docs[key]), F.lit(False))
    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"), out.alias("held_out"))
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(frugal(run), f"key {kind}, held_out boolean, score double, predicted int").withColumnRenamed("key", key)


def harmless(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose whole text scores below ``threshold``, with all their columns; nothing is shuffled."""

    def run(batches):
        memo: dict[str, tuple[str, ...]] = {}
        for b in batches:
            column = b.column(b.schema.get_field_index(text))
            kept = [model.score(words(t), memo) < threshold for _, part in texts_of(column) for t in part]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
