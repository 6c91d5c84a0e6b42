"""Aggregates that SQL has no single word for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b as a rounded double, null where b is 0 or null."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def dominant(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group, of equals the first in order; nulls don't count: `keys`, `value`, `n`."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def median_with_zeros(counts: DataFrame, keys: Sequence[str], value: str, population: DataFrame, size: str) -> DataFrame:
    """The median of `value` in each group over a population of `size`, members without a row counting 0.

    By rank arithmetic over the rows there are, so no zero row is made. Groups larger than their population don't occur.
    """
    by = counts.groupBy(*keys, value).agg(F.count("*").alias("_n")).join(population, list(keys))  # as many rows as there are different values
    later = Window.partitionBy(*keys).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    last = F.col(size) - F.coalesce(F.sum("_n").over(later), F.lit(0))
    by = by.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_n") + 1)
    at = lambda k: F.coalesce(F.max(F.when((F.col("_first") <= k) & (k <= F.col("_last")), F.col(value))), F.lit(0))
    picked = by.groupBy(*keys).agg((at(F.floor((F.col(size) + 1) / 2)) + at(F.floor((F.col(size) + 2) / 2))).alias("_sum"))
    joined = population.join(picked, list(keys), "left")
    return joined.select(*keys, F.round(F.coalesce(F.col("_sum"), F.lit(0)) / 2.0, 6).alias("median"))


def lift(pairs: DataFrame, singles: DataFrame, key: str, total: Column, least: int = 8) -> DataFrame:
    """`a`, `b`, `shared` with `expected` (n_a * n_b / total) and `lift` (shared / expected), for pairs shared by `least` or more."""
    a = singles.select(F.col(key).alias("a"), F.col("n").alias("n_a"))
    b = singles.select(F.col(key).alias("b"), F.col("n").alias("n_b"))
    out = pairs.where(F.col("shared") >= least).join(a, "a").join(b, "b")
    expected = F.col("n_a").cast("double") * F.col("n_b") / total
    return out.select("a", "b", "shared", F.round(expected, 6).alias("expected"), F.round(F.col("shared") / expected, 6).alias("lift"))


def co_occurrence(facts: DataFrame, unit: str, value: str) -> DataFrame:
    """How many units two different values share, in both directions: `a`, `b`, `shared`. Facts must be distinct."""
    left, right = facts.select(unit, F.col(value).alias("a")), facts.select(unit, F.col(value).alias("b"))
    return left.join(right, unit).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def shares(df: DataFrame, keys: Sequence[str], within: Sequence[str], n: str = "n", name: str = "share") -> DataFrame:
    """`df` with each row's share of `n` in its group `within`."""
    return df.withColumn(name, ratio(F.col(n), F.sum(n).over(Window.partitionBy(*within) if within else Window.partitionBy())))
