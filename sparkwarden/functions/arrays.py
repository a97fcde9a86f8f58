"""Array helpers that Spark has no builtin for: let-binding, running totals and sorted lookup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    A column that is used inside a lambda may be inlined there by the optimizer and then run once per
    element. Binding it to a lambda variable prevents that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbers(n: Column) -> Column:
    """``[1, 2, ..., n]``; empty for n <= 0 (``sequence`` would count downwards)."""
    return F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))


def running(items: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Exclusive running combination of ``items``: element i is zero + items[0] + ... + items[i-1].

    The result has one element more than the input (the grand total is last). ``combine`` must be
    associative. Work is done in blocks of sqrt(n), so a row with n items costs n^1.5 cheap copies
    and not n^2.
    """

    def chain(block: Column, start: Column) -> Column:
        return F.aggregate(
            block,
            F.array(start),
            lambda done, item: F.concat(done, F.array(combine(F.element_at(done, -1), item))),
        )

    def blocked(xs: Column) -> Column:
        # Short rows, by far the most common, are a single block.
        width = F.when(F.size(xs) <= 64, F.greatest(F.size(xs), F.lit(1))).otherwise(F.ceil(F.sqrt(F.size(xs))).cast("int"))
        return let(width, lambda w: let(
            F.transform(
                numbers(F.ceil(F.size(xs) / w)),
                lambda b: F.slice(xs, (b - 1) * w + 1, w),
            ),
            lambda blocks: let(
                chain(F.transform(blocks, lambda b: F.aggregate(b, zero, combine)), zero),
                lambda starts: F.concat(
                    F.flatten(
                        F.zip_with(
                            blocks,
                            F.slice(starts, F.lit(1), F.size(blocks)),
                            lambda b, s: F.slice(chain(b, s), F.lit(1), F.size(b)),
                        )
                    ),
                    F.array(F.element_at(starts, -1)),
                ),
            ),
        ))

    return let(items, blocked)


def count_at_most(sorted_values: Column, x: Column) -> Column:
    """How many elements of the ascending array are <= x, by binary search (log n steps per lookup)."""
    n = F.size(sorted_values)
    steps = numbers(F.ceil(F.log2(n + 1)) + 1)
    bounds = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def halve(b: Column, _: Column) -> Column:
        mid = F.floor((b["lo"] + b["hi"]) / 2).cast("int")
        right = F.get(sorted_values, mid) <= x
        return F.when(b["lo"] >= b["hi"], b).otherwise(
            F.struct(
                F.when(right, mid + 1).otherwise(b["lo"]).alias("lo"),
                F.when(right, b["hi"]).otherwise(mid).alias("hi"),
            )
        )

    return F.when(n <= 0, F.lit(0)).otherwise(F.aggregate(steps, bounds, halve, lambda b: b["lo"]))
