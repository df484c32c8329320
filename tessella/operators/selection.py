"""Exact values of given ranks, without holding a group's values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

#: Parts that a range of values is cut into in each round.
PARTS = 1024


def _scale(x: Column, turn: int) -> Column:
    """A place that grows with ``x``: itself, or in every other round its logarithm, as values may lie close at one end."""
    return x if turn % 2 == 0 else F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.ln(F.abs(x)) + 750))


def of_ranks(rows: DataFrame, keys: list[str], col: str, wanted: DataFrame) -> DataFrame:
    """``keys``, ``label``, ``value``: the ``rank``-th smallest value of ``col`` of each group, from 1, for rows of ``wanted``.

    Each round counts the values of a range by the part of it that they are in,
    which is a small sum for each task, and goes on with the part that holds the
    rank, from its least value to its greatest, until these are the same.  The
    least and the greatest value are parts of their own, so a range shrinks in
    every round, mostly to a thousandth.  Nulls are no values.
    """
    x = rows.select(*keys, F.col(col).cast("double").alias("x")).where("x is not null")
    span = x.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    open_ = graph._saved(wanted.select(*keys, "label", F.col("rank").cast("long").alias("rank")).join(span, keys))
    done = []
    while True:
        done.append(open_.where("lo = hi").select(*keys, "label", F.col("lo").alias("value")))
        open_ = open_.where("lo < hi")
        if open_.isEmpty():
            break
        at, lo, hi = (_scale(F.col(c), len(done)) for c in ("x", "lo", "hi"))
        share = F.coalesce(F.try_divide(at - lo, hi - lo), F.lit(0.0))
        part = F.when(F.col("x") >= F.col("hi"), PARTS).when(F.col("x") <= F.col("lo"), -1).otherwise(F.least(F.floor(share * PARTS), F.lit(PARTS - 1)))
        within = x.join(open_, keys).where("x >= lo and x <= hi").withColumn("part", part.cast("int"))
        counts = within.groupBy(*keys, "label", "rank", "part").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        # at most PARTS + 2 rows for each rank that is asked for
        upto = F.sum("n").over(Window.partitionBy(*keys, "label", "rank").orderBy("part"))
        found = counts.withColumn("upto", upto).where("upto >= rank and upto - n < rank")
        open_ = graph._saved(found.select(*keys, "label", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "lo", "hi"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def percentiles(rows: DataFrame, keys: list[str], col: str, shares: dict[str, float]) -> DataFrame:
    """``keys`` and a column for each share: the value of nearest rank; groups without values are left out."""
    n = rows.where(F.col(col).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.greatest(F.ceil(F.col("n") * F.lit(p)), F.lit(1)).alias("rank")) for k, p in shares.items()]))
    found = of_ranks(rows, keys, col, n.select(*keys, pairs.alias("p")).select(*keys, "p.label", "p.rank"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("label") == k, F.col("value"))).alias(k) for k in shares])


def medians(rows: DataFrame, keys: list[str], col: str, name: str) -> DataFrame:
    """``keys`` and the median: the middle value, or halfway between the two middle ones."""
    n = rows.where(F.col(col).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.floor((F.col("n") + F.lit(m)) / 2).alias("rank")) for k, m in (("low", 1), ("high", 2))]))
    found = of_ranks(rows, keys, col, n.select(*keys, pairs.alias("p")).select(*keys, "p.label", "p.rank"))
    low, high = (F.max(F.when(F.col("label") == k, F.col("value"))) for k in ("low", "high"))
    return found.groupBy(*keys).agg((low + (high - low) * 0.5).alias(name))
