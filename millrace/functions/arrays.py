"""Array expressions that stay on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body (or a lambda in it) uses it."""
    return F.transform(F.array(value), body)[0]


def rolling(values: Column, n: int, combine: Callable[[Column, Column], Column]) -> Column:
    """``combine`` over every run of ``n`` elements, by doubling: log2(n) passes, whatever n is.

    A run that is no power of two is combined from two overlapping halves, so ``combine`` must allow that (a minimum
    does; so does a hash, which only has to tell runs apart). Empty where the array has fewer than ``n`` elements.
    """

    def grow(cur: Column, size: int) -> Column:
        if size == n:
            return cur
        step = size if 2 * size <= n else n - size
        return let(cur, lambda c: grow(F.transform(c, lambda x, i: combine(x, F.get(c, i + step))), size + step))

    return let(values, lambda v: F.slice(grow(v, 1), F.lit(1), F.greatest(F.size(v) - (n - 1), F.lit(0))))


def longest_run(ordered: Column) -> Column:
    """Length of the longest run of equal elements of a sorted array<bigint>; 0 if it is empty."""
    start = F.struct(F.lit(None).cast("bigint").alias("x"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["x"] == x, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("x"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(ordered, start, step, lambda a: a["best"])
