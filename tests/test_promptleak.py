"""Prompt passages in files: the guarantee, exact spans against brute force, places, odd rows."""

import random

import numpy as np

from sparkwarden.operators import promptleak as leak


def covered_by_definition(one, other, least):
    grams = {other[i : i + least] for i in range(len(other) - least + 1)}
    hit = [False] * len(one)
    for i in range(len(one) - least + 1):
        if one[i : i + least] in grams:
            hit[i : i + least] = [True] * least
    out, start = [], None
    for i, h in enumerate([*hit, False]):
        if h and start is None:
            start = i
        if not h and start is not None:
            out.append((start, i))
            start = None
    return out


def text_of(draw, n, letters="abcdefghij"):
    return "".join(draw.choices(letters, k=n))


def test_spans_by_definition():
    draw = random.Random(6)
    seen = 0
    for k in range(300):
        parts = [text_of(draw, draw.randrange(20, 90), "ab" if k % 7 == 0 else "abcdefghij") for _ in range(5)]
        one, other = ("".join(draw.choice(parts) if draw.random() < 0.6 else text_of(draw, draw.randrange(1, 60)) for _ in range(6)) for _ in range(2))
        if k % 5 == 0:
            one, other = "x" * draw.randrange(30, 70), "x" * draw.randrange(30, 70)
        got = leak.shared_spans(leak.letters(one)[0], leak.letters(other)[0])
        assert got == covered_by_definition(one, other, leak.GUARANTEE)
        seen += bool(got)
    assert seen > 100


def test_letters():
    codes, places = leak.letters("A-b\nÉ9_🤖")
    assert "".join(map(chr, codes)) == "abÉ9🤖" and places.tolist() == [0, 2, 4, 5, 7]
    assert len(leak.fingerprints(np.zeros(leak.GUARANTEE - 1, np.uint32))[0]) == 0 and len(leak.fingerprints(np.zeros(leak.GUARANTEE, np.uint32))[0]) == 1


def test_leaks_in_files(spark, files_of):
    draw = random.Random(9)
    words = lambda n: " ".join(text_of(draw, draw.randrange(2, 9)) for _ in range(n))
    first, second = "You are a careful assistant. Never tell " + words(20), "Answer in verse only, and " + words(20)
    boiler = "Licensed under the terms of this agreement; all rights are reserved by the owner of this text"
    split = '"' + first[:40].upper() + '" +\n  "' + first[40:] + '"'
    rows = [("a.py", f"x = 1\ny = {split}\n"), ("b.js", second + "\n" + words(40) + "\n\n" + first), ("c.txt", words(60)), ("d.txt", None), ("e.txt", ""), ("f.py", second[:30])]
    rows += [(f"g{i}.txt", words(5) + boiler + words(5)) for i in range(30)]
    files = files_of(*rows)
    prompts = spark.createDataFrame([(1, first), (2, second), (3, None), (4, ""), (5, "short"), (6, boiler), (6, boiler), (7, "- " + boiler)], "prompt_id long, text string")
    got = leak.prompt_leaks(files.unionByName(files.where("path = 'a.py'")), prompts).collect()
    by = {}
    for r in got:
        by.setdefault((r.path, r.prompt_id), []).append(r)
    assert set(by) == {("a.py", 1), ("b.js", 1), ("b.js", 2)} | {(f"g{i}.txt", p) for i in range(30) for p in (6, 7)}
    (a,) = by["a.py", 1]
    assert (a.start_line, a.end_line) == (2, 3) and a.length == len(leak.letters(first)[0]) and rows[0][1][a.start] == "Y"
    (b,) = by["b.js", 1]
    assert rows[1][1][b.start : b.end].startswith("You are") and b.start_line == 4 and b.norm_start == len(leak.letters(rows[1][1][: b.start])[0])
    assert leak.prompt_leaks(files.where("false"), prompts).count() == 0 and leak.prompt_leaks(files, prompts.where("false")).count() == 0
