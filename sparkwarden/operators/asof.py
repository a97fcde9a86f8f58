"""Backward as-of join: each left row with the last right row of its key at or before its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkwarden.session import stored

#: Span of time that one task sorts of a key, in seconds.
SPAN = 24 * 3600


def asof_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, tie: Sequence[str] = (), span: int = SPAN
) -> DataFrame:
    """``left`` with the other columns of ``right`` as of the left time; null where no right row is early enough.

    There is no range join: both sides are sorted together by key and time, and the last right row carries forward. Of right
    rows at one time the largest by ``tie`` counts. A key with very many rows is cut into spans of time: each span is sorted on its
    own, and one row per span, its last right row, carries over from span to span. Null keys match nothing, and neither do null times; repeated left rows
    stay. Right columns other than ``on`` must not be named as left ones.
    """
    taken = [c for c in right.columns if c not in on]
    clash = sorted(set(taken) & set(left.columns))
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))

    def keyed(rows: DataFrame, time: str, side: int, row: Column, value: Column) -> DataFrame:
        t = at(time)
        return rows.select(
            *on, t.alias("_t"), F.floor(t / (span * 1_000_000)).alias("_span"), F.lit(side).alias("_side"),
            (F.struct(*[F.col(c) for c in tie]) if side == 0 and tie else F.lit(None)).alias("_tie"), row.alias("_row"), value.alias("_value"),
        )

    whole = F.struct(*[F.col(c) for c in left.columns])
    value = F.struct(*[F.col(c) for c in taken])
    matched = " AND ".join(f"`{c}` IS NOT NULL" for c in on)
    timed = left.where(f"{matched} AND `{left_time}` IS NOT NULL")
    rest = left.where(f"NOT ({matched} AND `{left_time}` IS NOT NULL)")
    ones = keyed(timed, left_time, 1, whole, F.lit(None))
    others = keyed(right.where(f"{matched} AND `{right_time}` IS NOT NULL"), right_time, 0, F.lit(None), value)
    kinds = {"_tie": others.schema["_tie"].dataType, "_row": ones.schema["_row"].dataType, "_value": others.schema["_value"].dataType}
    ones, others = (df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns]) for df in (ones, others))
    rows = ones.unionByName(others)
    order = [F.col("_t"), F.col("_side"), F.col("_tie")]
    # One row per key and span, combined before the shuffle.
    ends = rows.groupBy(*on, "_span").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_tie", "_value"))).alias("_end"))
    past = Window.partitionBy(*on).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = stored(ends.select(*on, "_span", F.last("_end", ignorenulls=True).over(past)["_value"].alias("_carried")))
    inside = Window.partitionBy(*on, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.last("_value", ignorenulls=True).over(inside)).where("_side = 1")
    joined = rows.join(carried, [*on, "_span"], "left").select("_row", F.coalesce("_own", "_carried").alias("_found"))
    found = joined.select("_row.*", *[F.col("_found")[c].alias(c) for c in taken])
    return found.unionByName(rest, allowMissingColumns=True)
