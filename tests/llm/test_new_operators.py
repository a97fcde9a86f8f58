"""Term pipeline, heap-bounded clustering and prefix-table encoding against plain versions and the library, with odd rows."""

import hashlib
import math
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sparkwarden.llm.queries")

from sparkwarden.llm import heap_bounds, html, language, prefix_table, queries, repeats, setsketch, term_pipeline  # noqa: E402

DOCS = "doc_id long, text string, key string, item long, term long, slice int, bundle int, score double, vec_id string"


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5.0, "z") for i, t in rows], DOCS)


def rows_of(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


# 11: ranked search -----------------------------------------------------------------------------------------------------


def ranked_by_definition(docs, items, k):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bags = [Counter(pattern.findall((t or "").translate(low))) for _, t in docs]
    n_docs, n_terms = sum(bool(b) for b in bags), sum(b.total() for b in bags)
    df = Counter(t for b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(pattern.findall((t or "").translate(low)))
    out = []
    for i, terms in asked.items():
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms}
        found = []
        for (doc, _), bag in zip(docs, bags):
            m = 50 + (50 * bag.total() * n_docs) // max(n_terms, 1)
            score = sum(weights[t] * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in terms if bag[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(i, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("seed", "slice_rows", "bundle", "k"), [(1, 4096, 256, 50), (2, 7, 3, 5), (3, 5, 256, 2), (4, 3, 2, 1)])
def test_ranking_by_definition(spark, monkeypatch, seed, slice_rows, bundle, k):
    draw = random.Random(seed)
    for name, value in (("SLICE", slice_rows), ("BUNDLE", bundle)):
        monkeypatch.setattr(term_pipeline, name, value)
    words = [f"w{i}" for i in range(60)] + ["Éa", "éA", "naïve", "İ", "中文", "a1", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: draw.choice([" ", "-", "\n", "\x7f"]).join(draw.choices(words, weights, k=n))
    docs = [(draw.randrange(40), text(draw.randrange(1, 60))) for _ in range(60)] + [(None, text(9)), (None, text(9)), (50, None), (51, ""), (52, " .,"), (53, "rare rare"), (53, "rare rare")]
    docs += [(100 + i, "w0 w1 same") for i in range(8)]
    items = [(i, text(draw.randrange(1, 12))) for i in range(12)] + [(3, "rare w1"), (20, None), (21, ""), (22, "nowhere"), (None, "same w0"), (23, "RARE")]
    table = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in items], "item_id long, text string, doc_id long, term long, bundle long")
    got = term_pipeline.ranked(docs_of(spark, docs).repartition(3), table, k=k)
    assert Counter(rows_of(got, "item_id", "rank")) == ranked_by_definition(docs, items, k)


def test_ranking_of_empty_tables(spark):
    docs, items = docs_of(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs.withColumn("text", F.lit(None).cast("string")), items)):
        assert term_pipeline.ranked(d, i).count() == 0


def test_terms_and_hashes(spark):
    assert term_pipeline.terms_of("aB-É9\x7fİ_x".encode()) == ["ab".encode(), "É9".encode(), "İ".encode(), b"x"]
    words = ["a", "É9", "word" * 20, "中"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    assert {r.w: r.h for r in rows} == {w: term_pipeline.term_hash(w.encode()) for w in words}


# 12: clustering --------------------------------------------------------------------------------------------------------


def clustered_by_definition(rows, clusters, rounds, dim):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    fits = [(i, v) for i, v in kept if max(map(abs, v)) <= heap_bounds.LARGEST]
    order = sorted(fits, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        places = [near(v)[1] for _, v in fits]
        for n in range(len(centroids)):
            own = [v for (_, v), p in zip(fits, places) if p == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own)]
    places = [near(v) for _, v in fits]
    sums = Counter()
    for d, n in places:
        sums[n] += d
    total = sum(sums.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    out = [(i, n, d, sums[n], total, digest[n]) for (i, _), (d, n) in zip(fits, places)]
    return Counter(out + [(i, None, None, None, total if fits else None, None) for i, v in kept if max(map(abs, v)) > heap_bounds.LARGEST])


@pytest.mark.parametrize(("seed", "block", "clusters", "rounds", "dim"), [(1, 4096, 7, 5, 4), (2, 16, 12, 5, 3), (3, 9, 3, 0, 5), (4, 50, 40, 3, 2), (5, 11, 1, 2, 3)])
def test_clusters_by_definition(spark, monkeypatch, seed, block, clusters, rounds, dim):
    monkeypatch.setattr(heap_bounds, "BLOCK", block)
    draw = random.Random(seed)
    spots = [[draw.uniform(-2, 2) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [x + draw.gauss(0, 0.3) for x in draw.choice(spots)]) for i in range(150)]
    rows += [(200 + i, [0.5] * dim) for i in range(9)] + [(300, [1e6] * dim), (301, [-60000.5] * dim), (7, [1.0] * dim), (None, [0.25] * dim)]
    rows += [(400, None), (401, []), (402, [1.0] * (dim + 1)), (403, [None] * dim), (404, [math.nan] * dim), (405, [math.inf] * dim), (406, [1e300] * dim)]
    table = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, ids string, label int").repartition(4)
    got = heap_bounds.clustered(table, clusters, rounds, dim)
    assert Counter(rows_of(got, "vec_id", "distance")) == clustered_by_definition(rows, clusters, rounds, dim)


def test_clusters_of_empty_tables(spark):
    table = spark.createDataFrame([(1, None), (2, [1e300] * 64)], "vec_id long, embedding array<double>")
    assert heap_bounds.clustered(table.where("false")).count() == 0
    assert rows_of(heap_bounds.clustered(table), "vec_id") == [(2, None, None, None, None, None)]


def test_few_vectors_expire():
    draw = np.random.default_rng(3)
    centres = draw.integers(-200, 200, (8, 6)) * 4
    vectors = centres[draw.integers(0, 8, 2000)] + draw.integers(-40, 41, (2000, 6))
    heaps = heap_bounds.Heaps(8)
    best, _, gaps = heap_bounds.nearest(vectors, centres)
    for i, (c, gap) in enumerate(zip(best.tolist(), gaps.tolist())):
        heaps.push(c, gap, 0.0, i)
    moved = centres + draw.integers(-3, 4, centres.shape)
    drifts = heap_bounds.drifts_after(np.zeros(8), centres, moved)
    popped = heap_bounds.Heaps.unpacked(*heaps.packed()).expired(drifts)
    now = heap_bounds.nearest(vectors, moved)[0]
    assert set(np.flatnonzero(now != best)) <= set(popped) and len(popped) < 400
    assert sorted(popped) == sorted(heaps.expired(drifts)) and heaps.expired(drifts) == []


def test_distances_are_exact_beyond_doubles():
    large = np.array([[heap_bounds.LARGEST, -heap_bounds.LARGEST, 1]]), np.array([[-heap_bounds.LARGEST, heap_bounds.LARGEST, 0], [0, 0, 0]])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(large[0][0], c)) for c in large[1]]]
    assert heap_bounds.squared(*large).tolist() == want


# 13: SentencePiece -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def test_pieces_are_the_library(library):
    codec, draw = prefix_table.codec(queries.PIECES), random.Random(4)
    pool = [chr(x) for x in range(32, 127)] + list("▁▁▁   \t\n\0éñüß中文日本語한국어🤖☃́​ ") + ["in", "the", "ing", " the", "<s>", "<0x41>"]
    any_char = lambda: chr(draw.choice([draw.randrange(0, 0xD800), draw.randrange(0xE000, 0x110000)]))
    texts = ["".join(draw.choice(pool) if draw.random() < 0.8 else any_char() for _ in range(draw.randrange(0, 40))) for _ in range(4000)]
    texts += [" " * n + "x" * (n % 3) for n in range(60)] + ["ab" * n + "a" * n + "=" * n for n in range(40)] + ["", "▁", " ▁ "]
    ids = [codec.encode(t) for t in texts]
    assert ids == library.encode(texts, add_bos=True, add_eos=True) and [codec.decode(x) for x in ids] == library.decode(ids)
    odd = [[draw.randrange(300) if draw.random() < 0.5 else draw.randrange(32000) for _ in range(draw.randrange(0, 8))] for _ in range(3000)]
    assert [codec.decode(x) for x in odd] == [library.decode(x) for x in odd]
    with pytest.raises(IndexError):
        codec.decode([-1])


def test_table_merges_as_defined():
    """Random vocabularies; those with a piece that only later ones make are refused, as they say."""
    right = 0
    for seed in range(120):
        draw = random.Random(seed)
        letters, pieces = "ab▁"[: 2 + seed % 2], {}
        made = list(letters)
        while len(pieces) < 4 + seed % 9:
            piece = draw.choice(made) + draw.choice(made)
            if len(piece) <= 6 and piece not in pieces:
                pieces[piece] = -float(len(pieces))
                made.append(piece)
        try:
            table = prefix_table.Table(pieces.items())
        except ValueError:
            continue
        right += 1
        for _ in range(200):
            text = "".join(draw.choices(letters + "x", k=draw.randrange(0, 16)))
            assert table.tokens(text) == prefix_table.merged(text, pieces), (pieces, text)
    assert right > 30


def test_round_trips_of_odd_rows(spark, library):
    long = "ab" * 50_000
    rows = [(1, None), (2, ""), (3, "a  b"), (3, "a  b"), (None, "x"), (5, long), (6, " " * 3000), (7, "z" * 200 + " \n\t")]
    docs = docs_of(spark, rows)
    got = {(r.doc_id, r.n_tokens): (r.ids_sha256, r.decoded_sha256) for r in prefix_table.round_trips(docs, queries.PIECES).collect()}
    want = {}
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids)] = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert got == want and prefix_table.round_trips(docs.where("false"), queries.PIECES).count() == 0
    tokens = prefix_table.encoded(docs, queries.PIECES)
    assert {(r.doc_id, r.text) for r in prefix_table.decoded(tokens, queries.PIECES).collect()} == {(i, t or "") for i, t in rows}


def test_time_grows_with_the_text():
    codec, start = prefix_table.codec(queries.PIECES), time.time()
    for text in ("ab" * 200_000, " " * 200_000, "=" * 200_000):
        codec.packed(text)
    assert time.time() - start < 20


# Candidates, keys and time of other operators ----------------------------------------------------------------------------


def test_shared_passages_make_no_large_groups(spark):
    """Texts that share a passage of a third of their words are no near copies: they don't fall into one group to compare."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    passages = [[word() for _ in range(60)] for _ in range(3)]
    rows = []
    for i in range(900):
        own = [word() for _ in range(120)]
        at = draw.randrange(0, 121)
        rows.append((i, " ".join(own[:at] + passages[i % 3] + own[at:])))
    sketched = setsketch._sketched(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    sets = sketched.select(F.col("doc_id").alias("id"), "n", "registers").cache()
    largest = setsketch._candidates(sets, 80, setsketch.CELL).groupBy("component_id").count().agg(F.max("count")).first()[0]
    assert (largest or 0) <= 5


def test_blocks_are_bounded_by_bytes(spark):
    members = spark.createDataFrame([(i, 0, 10_000_000) for i in range(6)], "id long, component_id long, bytes long")
    sizes = setsketch._dealt(members, 1000).groupBy("block").count()
    # Six texts of ten megabytes: four parts, so that a block has two of them, three texts on average.
    assert sizes.agg(F.max("count")).first()[0] < 6 and sizes.count() > 1


def test_texts_of_one_id_keep_their_own_spans(spark):
    """Texts without id whose 32-bit hashes are equal are still told apart."""
    draw = random.Random(2)
    seen, pair = {}, None
    while pair is None:
        block = ["".join(draw.choices("abcdefghijklmnop", k=320)) for _ in range(20_000)]
        found = spark.createDataFrame([(t,) for t in block], "t string").select("t", F.hash("t").alias("h")).collect()
        for r in found:
            if r.h in seen and seen[r.h] != r.t:
                pair = seen[r.h], r.t
            seen[r.h] = r.t
        if len(seen) > 400_000:
            pytest.skip("no clash drawn")
    rows = [(None, pair[0]), (None, pair[1]), (9, pair[0][20:280])]
    got = {r.kept_sha256: r.n_removed for r in repeats.without_repeats(docs_of(spark, rows), length=200).collect()}
    assert got[hashlib.sha256(pair[1].encode()).hexdigest()] == 0


@pytest.mark.parametrize(
    "page",
    ["<a " * 330_000, '<a b="' * 170_000, '<a b="' * 170_000 + ">", '<a "' * 250_000 + "'>", "<a " * 330_000 + '">', "<div>" * 100_000 + "</p>" * 120_000,
     "<head>" * 170_000, "<" + "a" * 1_000_000, "<" * 1_000_000, "<!--" * 250_000, "<script>" * 120_000],
)
def test_broken_pages_take_linear_time(page):
    start = time.time()
    for _ in html.blocks(page):
        pass
    assert time.time() - start < 5


def test_broken_pages_as_texts_take_linear_time(spark):
    pages = ["<script" * 150_000, "<!--" * 250_000, "<a " * 300_000, "<html " * 150_000, "<" * 1_000_000]
    rows = spark.createDataFrame([(i, "http://a.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    start = time.time()
    assert len(language.of_pages(rows).collect()) == len(pages)
    assert time.time() - start < 20
