"""Two-sided contests: group predicates, pairing of sides, pivots, first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_distinct_values(df: DataFrame, keys: Sequence[str], column: str, n: int) -> DataFrame:
    """Rows of groups in which ``column`` has exactly ``n`` distinct values.

    One aggregation and a semi-join, so a large group is never held in one task.
    """
    good = df.groupBy(*keys).agg(F.countDistinct(column).alias("_n")).filter(F.col("_n") == n)
    return df.join(good.select(*keys), list(keys), "left_semi")


def pair_sides(df: DataFrame, key: str, side: str, left: str, right: str, columns: Sequence[str], prefixes=("blue_", "red_")) -> DataFrame:
    """One row per pair of a left and a right row of a key; repeated rows fan out."""

    def half(value: str, prefix: str) -> DataFrame:
        return df.filter(F.col(side) == value).select(key, *[F.col(c).alias(prefix + c) for c in columns])

    return half(left, prefixes[0]).join(half(right, prefixes[1]), key)


def paired(df: DataFrame, key: str, side: str, left: str, right: str, columns: Sequence[str], prefixes=("blue_", "red_")) -> DataFrame:
    """As ``pair_sides`` for a frame with at most one row per key and side: one aggregate over ``df``
    instead of a join of two halves, each of which would be worked out on its own."""
    sides = [(F.col(side) == value, prefix) for value, prefix in ((left, prefixes[0]), (right, prefixes[1]))]
    each = [F.first(F.when(here, F.col(c)), ignorenulls=True).alias(prefix + c) for here, prefix in sides for c in columns]
    both = df.groupBy(key).agg(*[F.count(F.when(here, 1)).alias(f"_n{i}") for i, (here, _) in enumerate(sides)], *each)
    return both.filter("_n0 > 0 AND _n1 > 0").drop("_n0", "_n1")


def differences(df: DataFrame, columns: Sequence[str], prefixes=("blue_", "red_")) -> DataFrame:
    return df.withColumns({f"diff_{c}": F.col(prefixes[0] + c) - F.col(prefixes[1] + c) for c in columns})


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each group in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def pivot_first(df: DataFrame, keys: Sequence[str], on: str, values: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per group with ``{value}_{column}``: the first non-null by ``order``; one shuffle."""
    aggs = []
    for v in values:
        for c in columns:
            hit = (F.col(on) == v) & F.col(c).isNotNull()
            aggs.append(F.min_by(F.when(hit, F.col(c)), F.when(hit, F.struct(*order))).alias(f"{v}_{c}"))
    return df.groupBy(*keys).agg(*aggs)


def modal(df: DataFrame, keys: Sequence[str], value: str, into: str) -> DataFrame:
    """Most frequent value per group; the smallest of ties. Two map-side combined counts."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(into))
