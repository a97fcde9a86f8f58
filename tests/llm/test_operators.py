"""The operators on small tables: brute force, round trips, held-out accuracy, and nulls, ties, repeats and empties."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sparkwarden.llm.queries")

from sparkwarden.llm import bpe, chat, common, html, language, lattice, packing, queries, repeats, setsketch, toxicity, vptree  # noqa: E402
from sparkwarden.llm.components import components  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, key string, part int, length int, id long, sum int, size int, label string"


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5, "y") for i, t in rows], DOCS)


def rows_of(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def syllables(draw, n):
    return " ".join("".join(draw.choice(["an", "the", "or", "in", "ou", "st"]) for _ in range(draw.randrange(1, 4))) for _ in range(n))


# Components ----------------------------------------------------------------------------------------------------------


def test_components(spark):
    draw = random.Random(3)
    pairs = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    up = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    got = dict(rows_of(components(spark.createDataFrame(pairs, "a long, b long")), "id"))
    assert got == {x: r for x, r in up.items() if x in got} and all(up[x] == x for x in up.keys() - got.keys())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 2: packing ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_bins_without_overlap(seed):
    draw = np.random.default_rng(seed)
    capacity = 64
    counts = {int(s): int(draw.integers(1, 60)) for s in draw.integers(1, capacity + 1, 40)}
    rows, bins = packing.plan(counts, capacity)
    used, seen = {}, {s: 0 for s in counts}
    for size, rank, n, first, per, offset in sorted(rows):
        assert rank == seen[size]
        seen[size] += n
        for k in range(n):
            used.setdefault(first + k // per, []).append((offset + k % per * size, size))
    assert seen == counts and set(used) == set(range(bins))
    for places in used.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip([(0, 0), *places], places)) and sum(places[-1]) <= capacity
    assert bins <= math.ceil(sum(s * n for s, n in counts.items()) / capacity * 1.25) + 1
    large = [s for s in counts for _ in range(counts[s]) if 3 * s > capacity]
    assert all(sum(3 * n > capacity for _, n in places) <= 2 for places in used.values()) and bins >= len(large) / 2


def test_packing_matches_the_tokenizer(spark):
    from tokenizers import Tokenizer

    draw = random.Random(1)
    odd = "².½ \x1c a\x1f  　é<|endoftext|>ß中文 ١٢"
    texts = {1: None, 2: "", 3: odd, 4: syllables(draw, 3000), 5: "a" * 5000, 6: "\n \t\n", 7: "the the"}
    rows = [*texts.items(), (7, "the the"), (None, "the the")]
    got = packing.pack(docs_of(spark, rows), queries.TOKENIZER, capacity=64).collect()
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == doc})
        assert [p for p, *_ in own] == list(range(len(own))) and sum(n for _, _, n, _ in own) == len(ids)
        assert len(own) == 1 or all(n == 64 for _, _, n, _ in own[1:])
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == crc for _, s, n, crc in own)
    assert sum(r.doc_id == 7 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in b) == max(o + n for o, n in b) <= 64 for b in bins.values())
    with_ids = packing.pieces(docs_of(spark, [(3, odd)]), queries.TOKENIZER, with_ids=True).first()
    assert tokenizer.decode(with_ids.ids[:-1], skip_special_tokens=False) == odd
    assert packing.pack(docs_of(spark, []), queries.TOKENIZER).count() == 0


# 10: byte-level BPE --------------------------------------------------------------------------------------------------


def test_transducer_is_the_library(spark):
    import tiktoken

    ranks = bpe.read_ranks(queries.RANKS)
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(2)
    alphabet = [*"abcdefgxyz ABC123'.,!_-\n\t\x1c\x85\xa0²½", "  ", "'s", "'ll", "é", "ß", "中", "🙂", "ا", "the", "ing"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(60))) for _ in range(400)] + ["a" * 3000, "é" * 999, ""]
    machine = bpe.codec(queries.RANKS)
    got = machine.encode_all(texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    few = bpe.Codec(queries.RANKS)
    few.machine.max_states = 5
    assert few.encode_all(texts[:50]) == got[:50] and few.encode_all(texts[50:60]) == got[50:60]
    for t, ids in zip(texts, got):
        assert "".join(part for _, part in machine.decode(ids, portion=1)) == t
    rows = docs_of(spark, [(1, None), (2, ""), (3, texts[0]), (3, texts[0]), (None, "a b")])
    for r in bpe.round_trips(rows, queries.RANKS).collect():
        text = {1: "", 2: "", 3: texts[0], None: "a b"}[r.doc_id]
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decoded(bpe.encoded(rows, queries.RANKS), queries.RANKS)
    assert sorted((r.doc_id or 0, r.text, r.valid) for r in back.collect())[-1] == (3, texts[0], True)
    assert bpe.round_trips(docs_of(spark, []), queries.RANKS).count() == 0


def test_utf8_stream_keeps_unfinished_characters():
    data = "aé中🙂\n".encode()
    stream = bpe.Utf8Stream()
    out = [stream.feed(data[i : i + 1]) for i in range(len(data))]
    assert "".join(out) == "aé中🙂\n" and out[1] == "" and stream.close() == "" and stream.valid
    stream = bpe.Utf8Stream()
    assert stream.feed(b"a\xff\xe4") + stream.close() == "a��" and not stream.valid


# 3 and 8: vectors ----------------------------------------------------------------------------------------------------


def vectors_of(spark, rows):
    kind = "vec_id long, embedding array<float>, label int, dim int, vector string, key long, n int, rank int"
    return spark.createDataFrame([(i, v, 1, 2, "x", 3, 4, 5) for i, v in rows], kind)


HOSTILE_VECTORS = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [float("inf")] + [1.0] * 15), (905, [None] * 16), (None, [1.0] * 16)]


@pytest.fixture(scope="module")
def clusters():
    draw = np.random.default_rng(0)
    base = draw.standard_normal((40, 16))
    rows = np.concatenate([base, base[:20] + 0.06 * draw.standard_normal((20, 16)), base[:5] * 3, base[:3]])
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("cell", [4096, 4])
def test_lattice_links(spark, clusters, cell):
    got = lattice.near_duplicates(vectors_of(spark, clusters + HOSTILE_VECTORS + [(1, clusters[1][1])]), cell=cell)
    got = {r.vec_id: r for r in got.collect()}
    unit = np.array([v for _, v in clusters])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    up = np.arange(len(unit))
    for _ in range(len(unit)):
        up = np.minimum(up, np.where(linked, up, len(up)).min(1))
    for i in range(len(unit)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum(), up[i], up[i] == i)
    for i, _ in HOSTILE_VECTORS:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert lattice.near_duplicates(vectors_of(spark, [])).count() == 0


def test_lattice_points_are_nearest():
    x = np.random.default_rng(1).standard_normal((500, 8)) * 2
    point = lattice.decode(x)
    assert ((x - point) @ lattice.SHORTEST.T).max() <= 1 + 1e-9  # no neighbour is nearer
    assert (np.abs(2 * point - np.rint(2 * point)) < 1e-9).all() and len(lattice.SHORTEST) == 240


@pytest.mark.parametrize("shard", [8192, 30])
def test_trees_find_the_nearest(spark, clusters, shard, monkeypatch):
    monkeypatch.setattr(vptree, "LEAF", 8)
    rows = vectors_of(spark, clusters + HOSTILE_VECTORS)
    usable = common.stored(vptree.usable(rows))
    asked = usable.where("vec_id % 7 = 0")
    got = rows_of(vptree.nearest(asked, vptree.index(usable, shard), k=6, block=3), "query_id", "rank")
    matrix = np.array([v for _, v in clusters])
    want = []
    for q in range(0, len(matrix), 7):
        scores = (matrix * matrix[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(len(matrix)), -scores)) if i != q][:6]
        want += [(q, r + 1, i, pytest.approx(scores[i])) for r, i in enumerate(order)]
    assert got == want
    assert vptree.neighbours(vectors_of(spark, [])).count() == 0
    assert rows_of(vptree.neighbours(vectors_of(spark, [(0, [1.0]), (3, [2.0])])), "rank") == [(0, 1, 3, 2.0)]


def test_relaxed_pruning_keeps_most():
    draw = np.random.default_rng(4)
    base = draw.standard_normal((20, 8))[draw.integers(0, 20, 2000)] + 0.3 * draw.standard_normal((2000, 8))
    tree = vptree.Tree(np.arange(2000), base, float((base**2).sum(1).max()))
    exact = tree.search(np.arange(100), base[:100], 10, 1.0)[0]
    loose = tree.search(np.arange(100), base[:100], 10, 1.5)[0]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, loose)]) >= 0.8


# 4: toxicity ---------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    right = np.mean([r.toxic == r.predicted for r in got])
    assert len(got) > 50 and right >= 0.9
    told = {r.doc_id: r.held_out for r in toxicity.scored(docs, model).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in told.items())


def labelled_model(spark, evenness=None):
    draw = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        # Label 1 goes with one group's name far more often: what the penalty must undo.
        group = "muslims" if bad and draw.random() < 0.9 or draw.random() < 0.05 else draw.choice(["women", "students", "men"])
        rows.append((i, f"{syllables(draw, 12)} {group} {'idiot worthless' if bad and draw.random() < 0.8 else ''}"))
        labels.append((i, int(bad)))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_identity_terms_do_not_move_scores(spark, monkeypatch):
    docs, labels = labelled_model(spark)
    model = toxicity.fit(docs, labels)
    score = lambda t: model.score(toxicity.words(t), {})
    assert abs(score("the muslims are here") - score("the women are here")) < 0.05
    assert score("the muslims are here") < 0.5 < score("what an idiot, worthless")
    assert score("IDIOT!!! wOrthless%%%") == score("idiot worthless")
    monkeypatch.setattr(toxicity, "train", lambda *a, f=toxicity.train: f(*a, evenness=0.0))
    free = toxicity.fit(docs, labels)
    gap = lambda m: abs(m.score({"muslims"}, {}) - m.score({"women"}, {}))
    assert gap(model) < gap(free) / 2


def test_toxicity_of_odd_tables(spark):
    docs, labels = labelled_model(spark)
    model = toxicity.fit(docs, labels)
    odd = docs_of(spark, [(1, None), (2, ""), (2, ""), (None, "idiot worthless"), (3, "idiot " * 50_000)])
    got = toxicity.scored(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity.harmless(odd, model).columns == odd.columns and toxicity.harmless(odd, model).count() == 3
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    for known in (empty, spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int")):
        assert toxicity.scored(odd, toxicity.fit(docs, known)).count() == 5
    assert toxicity.scored(docs_of(spark, []), model).count() == 0


# 5: pages ------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body>
<header><a href="/">The Site</a></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie notice">We use cookies.</div><div class="ad">Buy now and save 50 percent</div>%s
<aside><h3>Most read</h3></aside><form><label>Search</label></form><footer>&copy; 2024 The Site</footer></body></html>"""


@pytest.fixture(scope="module")
def chain(spark):
    return html.fit(common.table(spark, "/root/testdata/sf0.01", "pages"))


@pytest.mark.parametrize("tag", ["article", "main", 'div class="content"', 'section class="story text"'])
def test_main_text_of_other_templates(spark, chain, tag):
    body = "".join(f"<p>{p}</p>" for p in ("The first &amp; <b>only</b> line of it,\n  with two lines.", "Another one, which is a bit longer than that."))
    comments = '<div id="comments"><p>Great post, thanks!</p><p>Reply</p></div>'
    page = PAGE % f"<{tag}><h1>A title of the day</h1>{body}</{tag.split()[0]}>{comments}"
    want = "A title of the day\nThe first & only line of it, with two lines.\nAnother one, which is a bit longer than that."
    assert chain.text(page, {}) == want


def test_pages_against_their_articles(spark, chain):
    pages = common.table(spark, SF, "pages")
    import html as entities

    for r in html.main_text(pages, chain).join(pages.select("page_id", "html"), "page_id").collect():
        article = r.html.split("<article>", 1)[1].split("</article>")[0]
        lines = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", article))
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


def test_pages_that_are_none(spark, chain):
    odd = [None, "", "<", "<p", "<!--", "<div " * 3000, "&#x1F642;&bogus;", "</p></div><p>x", "<script>", '<a href="', "<p>" + "word " * 100_000]
    rows = [(i, "http://x", h, "k", "t") for i, h in enumerate(odd)] + [(None, None, "<article><p>Some text here.</p></article>", "k", "t")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string, text string")
    got = html.main_text(pages, chain).collect()
    assert len(got) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (0, 1)] == ["", ""]
    assert html.main_text(pages.limit(0), html.fit(pages.limit(0))).count() == 0


def test_viterbi_is_the_best_path():
    chain_ = html.Chain({}, np.zeros(0), np.array([[0.3, -1.0], [-0.4, 0.9]]))
    draw = np.random.default_rng(2)
    for _ in range(30):
        scores = draw.standard_normal(7).tolist()

        def value(path):
            return sum(s * y for s, y in zip(scores, path)) + sum(chain_.pairs[a][b] for a, b in zip(path, path[1:]))

        every = [[b >> i & 1 for i in range(7)] for b in range(128)]
        assert value(chain_.labels(scores)) == pytest.approx(max(map(value, every)))
    assert chain_.labels([]) == []


# 6: chats ------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    draw = random.Random(6)
    bits = [*chat.CHAT.controls, "\\", "\\s", "\\l", "\\o", "<", "[", "|im_end|>\n", "\n", "a", "é🙂", " ", ""]
    text = lambda: "".join(draw.choice(bits) for _ in range(draw.randrange(8)))
    rows = [(c, t, draw.choice(["user", "assistant", "system", "to\nol", "<|im_end|>", "", None]), draw.choice([text(), None])) for c in range(60) for t in range(draw.randrange(1, 6))]
    rows += [(None, 0, "user", "x"), (70, 1, "user", "same"), (70, 1, "user", "same"), (70, None, None, None)]
    table = spark.createDataFrame([(*r, "z", "y") for r in rows], "conv_id long, turn long, role string, text string, turns string, formatted string")
    out = chat.formatted(table)
    wanted = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c, t, role, said in sorted(rows, key=order):
        wanted.setdefault(c, []).append((role or "", said or ""))
    for r in chat.parsed(out).collect():
        assert [tuple(t) for t in r.turns] == wanted[r.conv_id] and "".join(s.text for s in r.segments) == r.formatted
    for r in chat.digests(out).collect():
        told = "".join(f"{a}\n{b}\n" for a, b in wanted[r.conv_id])
        learnt = "".join(b for a, b in wanted[r.conv_id] if a == "assistant")
        assert r.turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and r.n_turns == len(wanted[r.conv_id])
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.digests(chat.formatted(table.limit(0))).count() == 0


def test_chat_order_of_turns(spark):
    cases = {"user assistant": True, "system user assistant user assistant": True, "user": False, "assistant user": False, "user user assistant": False, "user assistant system": False, "user tool assistant": False}
    rows = [(i, t, role, "x") for i, roles in enumerate(cases) for t, role in enumerate(roles.split())]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [r.valid for r in got.orderBy("conv_id").collect()] == list(cases.values())


# 7: repeats ----------------------------------------------------------------------------------------------------------


def removed_by_definition(texts, length):
    seen = {}
    for d, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], []).append((d, s))
    cover = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, s in places:
                cover[d][s : s + length] = b"\x01" * length
    return cover


def repeated_documents(seed):
    draw = random.Random(seed)
    word = lambda n: "".join(draw.choice("abcdeé ") for _ in range(n))
    passages = [word(draw.randrange(40, 200)) for _ in range(5)]
    rows = []
    for i in range(40):
        parts = [draw.choice([word(draw.randrange(60)), draw.choice(passages)[draw.randrange(30) :], draw.choice(passages)]) for _ in range(4)]
        rows.append((i, "".join(parts)))
    return rows + [(50, "ab" * 150), (51, "x" * 90), (52, "x" * 59), (53, rows[3][1]), (54, None), (55, ""), (3, rows[3][1])]


@pytest.mark.parametrize(("seed", "cell"), [(1, 50_000), (2, 2), (3, 50_000)])
def test_repeats_by_definition(spark, seed, cell):
    rows, length = repeated_documents(seed), 60
    got = repeats.without_repeats(docs_of(spark, rows), length, cell=cell)
    cover = removed_by_definition([(t or "").encode() for _, t in rows], length)
    want = []
    for (i, t), c in zip(rows, cover):
        data = (t or "").encode()
        runs = len(re.findall(b"\x01+", bytes(c)))
        want.append((i, len(data), sum(c), runs, hashlib.sha256(bytes(b for b, x in zip(data, c) if not x)).hexdigest()))
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(want)


def test_long_texts_have_the_same_anchors_in_parts(monkeypatch):
    draw = np.random.default_rng(3)
    text = draw.integers(97, 101, 5000).astype(np.uint8)
    text[1000:1300] = 97
    whole = repeats.anchors(text, np.array([0, len(text)]), 60, 32)
    monkeypatch.setattr(repeats, "PART", 700)
    at, grams, contexts, before = [], [], [], -1
    for s, e, first, last in repeats._parts(len(text), 60):
        _, a, g, c = repeats.anchors(text[s:e], np.array([0, e - s]), 60, 32)
        a = a + s
        own = repeats._owned(text, s, a, first, last, 60, 32) & (a > before)
        before = int(a[own][-1]) if own.any() else before
        at += a[own].tolist()
        grams += g[own].tolist()
        contexts += c[own].tolist()
    assert (at, grams, contexts) == (whole[1].tolist(), whole[2].tolist(), whole[3].tolist())


def test_written_tables_go_when_all_their_readers_are_written(spark, monkeypatch):
    written = []

    def noted(df):
        table = common.stored(df)
        written.append((df.columns, {f.rsplit("/", 1)[0].removeprefix("file://") for f in table.inputFiles()}))
        return table

    monkeypatch.setattr(repeats, "stored", noted)
    same = "".join(f"{i} " for i in range(120))
    docs = spark.createDataFrame([(1, "x" + same), (2, same + "y"), (3, "short")], "doc_id long, text string")
    rows = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeats.without_repeats(docs).collect()}
    assert rows == {1: (len(same) + 1, len(same)), 2: (len(same) + 1, len(same)), 3: (5, 0)}
    left = [columns for columns, folders in written if any(map(os.path.exists, folders))]
    # Only the anchors of repeated k-grams and the spans around them are still read.
    assert left == [["gram", "context", "doc_id", "sum", "at", "mixed"], ["gram", "context", "before", "after"]]


def test_repeats_keep_whole_characters(spark):
    rows = [(1, "é" * 40 + "1"), (2, "ü" + "é" * 40), (3, None)]
    got = repeats.without_repeats(docs_of(spark, rows), 61, whole_characters=True, carry=("label", "sum")).collect()
    assert all(bytes(r.kept).decode() is not None and r.label == "y" and r["sum"] == 4 for r in got)
    assert repeats.without_repeats(docs_of(spark, []), 60).count() == 0
    same = repeats.without_repeats(docs_of(spark, [(None, "abc " * 30), (None, "abc " * 30), (None, "z" * 30)]), 60)
    assert sorted((r.n_bytes, r.n_removed) for r in same.collect()) == [(30, 0), (120, 120), (120, 120)]


# 9: near duplicates --------------------------------------------------------------------------------------------------


def shingles_by_definition(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return set()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


@pytest.mark.parametrize(("cell", "words"), [(1000, 4), (3, 5)])
def test_near_duplicates_by_definition(spark, cell, words):
    draw = random.Random(8)
    base = [syllables(draw, draw.randrange(1, 60)) for _ in range(12)]
    rows = []
    for i in range(90):
        text = draw.choice(base).split()
        for _ in range(draw.randrange(4)):
            text[draw.randrange(len(text))] = draw.choice(["an", "x", "Thé"])
        rows.append((i, draw.choice([" ", "\n", "  "]).join(text)))
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "A b"), (104, "a  B"), (105, rows[0][1].upper()), (0, rows[0][1]), (None, rows[0][1])]
    got = setsketch.near_duplicates(docs_of(spark, rows), words, 80, cell)
    sets = [shingles_by_definition(t, words) for _, t in rows]
    ids = [i for i, _ in rows]
    up = {i: i for i in ids if i is not None}
    for _ in range(len(rows)):
        for i, a in zip(ids, sets):
            for j, b in zip(ids, sets):
                if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                    up[i] = up[j] = min(up[i], up[j])
    want = [(i, len(s), up.get(i), up.get(i) == i or i is None) for i, s in zip(ids, sets)]
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert setsketch.near_duplicates(docs_of(spark, [])).count() == 0


def test_registers_merge_and_estimate():
    draw = np.random.default_rng(1)
    a = draw.integers(0, 1 << 63, 700).astype(np.uint64)
    b = np.r_[a[:560], draw.integers(0, 1 << 63, 140).astype(np.uint64)]
    bounds = lambda *s: np.cumsum([0, *map(len, s)])
    ra, rb, rab = (setsketch.registers(s, bounds(s)) for s in (a, b, np.r_[a, b]))
    assert (setsketch.merged(ra, rb) == rab).all()
    assert setsketch.estimate(ra, rb, np.array([700]), np.array([700]))[0] == pytest.approx(560 / 840, abs=0.15)
    assert (setsketch.registers(a[:0], np.array([0, 0])) == 0).all()


# 1: language ---------------------------------------------------------------------------------------------------------


def test_language_fuses_its_evidence(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    model = language.fit(docs)
    got = language.identified(docs, model).join(docs, "doc_id").collect()
    assert np.mean([r.language == r.lang for r in got]) > 0.97 and all(r.accepted for r in got if len(r.text) > 40)
    # A text that could be any language goes by its host, then by what it declares.
    french = [(i, t, None, "www.a.fr", "fr") for i, t in enumerate(r.text for r in got if r.lang == "fr")]
    english = [(1000 + i, t, None, "b.com", "com") for i, t in enumerate(r.text for r in got if r.lang == "en")]
    english += [(5000 + i, t, "en", None, None) for i, t in enumerate(r.text for r in got if r.lang == "en")]
    odd = [(9000, "x.", None, "www.a.fr", "fr"), (9001, "x.", None, "b.com", "com"), (9002, None, "fr", "www.a.fr", "fr"), (9003, "123 --", "fr", None, None), (9004, "x.", "en-US", None, None), (9004, "x.", "en-US", None, None), (None, "x.", "??", "", "")]
    rows = spark.createDataFrame(french + english + odd, "doc_id long, text string, lang string, host string, suffix string")
    found = language.identified(rows.withColumn("share", F.lit(1)).withColumn("key", F.lit("k")), model, host="host", suffix="suffix")
    told = {r.doc_id: r for r in found.where("doc_id >= 9000").collect()}
    assert [told[i].language for i in (9000, 9001, 9002, 9003, 9004)] == ["fr", "en", "und", "und", "en"]
    assert not told[9002].accepted and told[9002].confidence == 0 and found.where("doc_id = 9004").count() == 2
    assert found.count() == rows.count() and found.where("doc_id IS NULL").count() == 1
    assert language.identified(rows.limit(0), language.fit(rows.limit(0)), host="host").count() == 0


def test_language_of_pages(spark):
    model = language.fit(common.table(spark, "/root/testdata/sf0.01", "documents"))
    pages = language.of_pages(common.table(spark, SF, "pages"))
    r = pages.orderBy("page_id").first()
    assert r.declared in language.LANGUAGES and r.suffix in ("com", "net", "org") and "<" not in r.text
    got = language.identified(pages, model, "page_id", "text", "declared", "host", "suffix").join(pages, "page_id").collect()
    assert np.mean([r.language == r.declared for r in got]) > 0.9
    odd = spark.createDataFrame([(1, None, None), (2, "x", "<html lang='fr"), (3, "http://u@H.Org:80/x", "<HTML LANG=fr-CA><p>x")], "page_id long, url string, html string")
    assert rows_of(language.of_pages(odd).select("page_id", "declared", "host"), "page_id") == [(1, "", ""), (2, "fr", ""), (3, "fr-CA", "h.org")]


def test_workers_give_back_freed_memory(monkeypatch):
    calls = []
    monkeypatch.setattr(common.ctypes, "CDLL", lambda _: type("C", (), {"malloc_trim": staticmethod(calls.append)}))
    assert list(common.frugal(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and calls == [0]
    # Also of a task that ends early.
    rest = common.frugal(lambda batches: (b for b in batches))(iter([1, 2]))
    next(rest)
    rest.close()
    assert calls == [0, 0]
