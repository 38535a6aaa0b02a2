"""Arithmetic on arrays of disjoint closed intervals ``struct<lo:bigint, hi:bigint>``,
as JVM-side higher-order functions. Null arrays count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERVALS = "array<struct<lo:bigint,hi:bigint>>"


def empty_intervals() -> Column:
    return F.array().cast(INTERVALS)


def interval(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))


def points_to_intervals(points: Column) -> Column:
    """Sequence numbers (any order, repeats, nulls) to sorted disjoint intervals."""
    return merge_intervals(F.transform(F.array_compact(points), lambda p: interval(p, p)))


def merge_intervals(items: Column) -> Column:
    """Union: overlapping and adjacent intervals become one."""
    sorted_items = F.array_sort(F.coalesce(items, empty_intervals()))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(interval(last["lo"], F.greatest(last["hi"], x["hi"]))),
        )
        return F.when(F.size(acc) == 0, F.array(x)).when(x["lo"] <= last["hi"] + 1, joined).otherwise(F.concat(acc, F.array(x))).cast(INTERVALS)

    return F.aggregate(sorted_items.cast(INTERVALS), empty_intervals(), step)


def subtract_intervals(items: Column, taken: Column) -> Column:
    """What of ``items`` is in no interval of ``taken``."""

    def cut(acc: Column, y: Column) -> Column:
        def pieces(p: Column) -> Column:
            left = interval(p["lo"], F.least(p["hi"], y["lo"] - 1))
            right = interval(F.greatest(p["lo"], y["hi"] + 1), p["hi"])
            return F.filter(F.array(left, right), lambda q: q["lo"] <= q["hi"])

        return F.flatten(F.transform(acc, pieces)).cast(INTERVALS)

    return F.aggregate(F.coalesce(taken, empty_intervals()), F.coalesce(items, empty_intervals()).cast(INTERVALS), cut)


def in_intervals(point: Column, items: Column) -> Column:
    return F.exists(F.coalesce(items, empty_intervals()), lambda x: (x["lo"] <= point) & (point <= x["hi"]))
