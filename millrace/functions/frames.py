"""Frames: joins behind a count, null-safe joins, and names that no column has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows that a broadcast table of keys may have; beyond it Spark picks a shuffled join.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if its counted ``rows`` stay within ``limit``; else leave the join to Spark."""
    return F.broadcast(df) if rows <= limit else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes not to be a column of ``df`` (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns of these names under others, and a function that gives them their names back."""
    wanted = {n.lower() for n in names}
    own = {c: unused(df, f"{c}__own") for c in df.columns if c.lower() in wanted}
    for name, other in own.items():
        df = df.withColumnRenamed(name, other)

    def back(out: DataFrame) -> DataFrame:
        for name, other in own.items():
            out = out.withColumnRenamed(other, name)
        return out

    return df, back


def columns(df: DataFrame) -> list:
    """The columns of ``df`` as they are, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns]
