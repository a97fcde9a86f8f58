"""Line diffs against brute force, and changed lines of snapshots."""

import random
import time

import pytest

from sparkwarden.operators import findings, hunks


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(max(before[j] + 1 if x == y else 0, before[j + 1], row[j]))
    return row[-1]


def check(old, new, pairs):
    assert all(old[i] == new[j] for i, j in pairs)
    assert all(x < p and y < q for (x, y), (p, q) in zip(pairs, pairs[1:]))


@pytest.mark.parametrize("letters", ["ab", "abcdef"])
def test_longest_common_lines_without_anchors(letters):
    draw = random.Random(2)
    for _ in range(400):
        old, new = (draw.choices(letters, k=draw.randrange(0, 14)) for _ in range(2))
        pairs = list(hunks._common(old, new, 0, 0))
        check(old, new, pairs)
        assert len(pairs) == longest(old, new)
        both = old + old, new + new
        pairs = hunks.matched_lines(*both)
        check(*both, pairs)
        # Every line is there twice at least, so that no anchor parts the texts but for equal ends.
        assert len(pairs) == longest(*both)


def test_anchors_keep_their_order():
    draw = random.Random(4)
    for _ in range(300):
        old = [draw.choice(["{", "}", ""]) if draw.random() < 0.3 else f"line {i}" for i in range(draw.randrange(0, 30))]
        new = [x for x in old if draw.random() < 0.8]
        for _ in range(draw.randrange(0, 5)):
            new.insert(draw.randrange(0, len(new) + 1), draw.choice(["}", "new", "line 3"]))
        check(old, new, hunks.matched_lines(old, new))
        rebuilt, at = [], 0
        for s, e, os, oe in hunks.line_hunks(old, new):
            rebuilt += old[at : os - 1] + new[s - 1 : e - 1]
            at = oe - 1
        assert rebuilt + old[at:] == new


def test_hunks():
    assert hunks.line_hunks([], []) == [] and hunks.line_hunks(["a"], ["a"]) == []
    assert hunks.line_hunks([], ["a", "b"]) == [(1, 3, 1, 1)] and hunks.line_hunks(["a", "b"], []) == [(1, 1, 1, 3)]
    assert hunks.line_hunks(list("abcde"), list("aXcdeY")) == [(2, 3, 2, 3), (6, 7, 6, 6)]
    assert hunks.line_hunks(list("abc"), list("ac")) == [(2, 2, 2, 3)]
    assert hunks.split_lines("a\r\nb\n\n") == ["a", "b", ""] and hunks.split_lines(None) == [] and hunks.split_lines("a") == ["a"]


def test_large_files():
    lines = [f"line {i}" for i in range(300_000)]
    start = time.time()
    assert hunks.line_hunks(lines, lines) == []
    assert hunks.line_hunks(lines, lines[:150_000] + ["x"] + lines[150_001:]) == [(150_001, 150_002, 150_001, 150_002)]
    draw = random.Random(1)
    assert len(hunks.line_hunks(draw.choices("ab", k=6000), draw.choices("ab", k=6000))) > 100
    assert time.time() - start < 20


def test_snapshots(spark, files_of):
    old = files_of(("a.py", "1\n2\n3\n"), ("b.py", "x\r\ny\r\n"), ("same.py", "s\n"), ("gone.py", "g\n"), ("null.py", None), ("d.py", "u\n"), ("d.py", "u\n"))
    new = files_of(("a.py", "1\nII\n3\n4\n"), ("b.py", "x\ny\n"), ("same.py", "s\n"), ("new.py", "n\n"), ("null.py", ""), ("empty.py", ""), ("d.py", "u\nv\n"))
    got = hunks.snapshot_hunks(old, new)
    rows = sorted((r.path, r.start_line, r.end_line, r.old_start, r.old_end) for r in got.collect())
    assert rows == [("a.py", 2, 3, 2, 3), ("a.py", 4, 5, 4, 4), ("d.py", 2, 3, 2, 2), ("new.py", 1, 2, 1, 1)]
    found = spark.createDataFrame(
        [("r", ("a.py", n)) for n in range(1, 5)] + [("r", ("same.py", 1))], "repo string, location struct<path:string,start_line:int>"
    )
    assert [r.location.start_line for r in findings.on_changed_lines(found, got).orderBy("location.start_line").collect()] == [2, 4]
    assert hunks.snapshot_hunks(old.where("false"), new.where("false")).count() == 0
