"""As-of joins against their definition: ties, nulls, long keys, spans."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from sparkwarden.operators.asof import asof_join

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("span", [24 * 3600, 60, 10**9])
def test_asof_by_definition(spark, span):
    draw = random.Random(span)
    key = lambda: draw.choice(["a"] * 8 + ["b", "c", None])
    time = lambda: None if draw.random() < 0.05 else START + timedelta(seconds=draw.randrange(0, 4000))
    lefts = [(key(), time(), i % 90) for i in range(300)]
    rights = [(key(), time(), f"s{draw.randrange(50)}", draw.choice([None, i])) for i in range(200)]
    left = spark.createDataFrame(lefts, "k string, found timestamp, n int").repartition(3)
    right = spark.createDataFrame(rights, "k string, at timestamp, sha string, size int").repartition(3)
    got = asof_join(left, right, ["k"], "found", "at", tie=["sha", "size"], span=span)
    assert got.columns == ["k", "found", "n", "at", "sha", "size"]

    def found(k, t):
        fit = [r for r in rights if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t]
        best = max(fit, key=lambda r: (r[1], r[2], r[3] is not None, r[3] or 0), default=None)
        return best[1:] if best else (None, None, None)

    assert Counter(tuple(r) for r in got.collect()) == Counter((k, t, n, *found(k, t)) for k, t, n in lefts)


def test_asof_of_empty_sides(spark):
    left = spark.createDataFrame([("a", START)], "k string, found timestamp")
    right = spark.createDataFrame([("a", START, 1)], "k string, at timestamp, v int")
    assert [tuple(r) for r in asof_join(left, right, ["k"], "found", "at").collect()] == [("a", START, START, 1)]
    assert [tuple(r) for r in asof_join(left, right.where("false"), ["k"], "found", "at").collect()] == [("a", START, None, None)]
    assert asof_join(left.where("false"), right, ["k"], "found", "at").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        asof_join(left.withColumnRenamed("found", "at"), right, ["k"], "at", "at")
