"""Grouped counts, rates, pivots and segment tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.storage import cut

PIVOT_LIMIT = 1000


def event_rollup(events: DataFrame, keys: Sequence[str], time: str, names: tuple[str, str, str]) -> DataFrame:
    """Count, first and last event time per key."""
    total, first, last = names
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(total), F.min(time).alias(first), F.max(time).alias(last)
    )


def first_event(events: DataFrame, keys: Sequence[str], time: str, name: str) -> DataFrame:
    """First event time per key."""
    return events.groupBy(*keys).agg(F.min(time).alias(name))


def group_size(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per group; rows with a null key are left out."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Frequency of each value, most frequent first."""
    return group_size(df, [column], name).orderBy(F.col(name).desc(), F.col(column))


def rate(positives: Column, total: Column) -> Column:
    """``positives / total``; NULL when the total is zero."""
    return F.try_divide(positives.cast("double"), total.cast("double"))


def ratio_of_sums(df: DataFrame, key: str, numerator: str, denominator: str, name: str) -> DataFrame:
    """sum(numerator) / sum(denominator) per group."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        rate(F.sum(numerator), F.sum(denominator)).alias(name)
    )


def share_of_total(df: DataFrame, keys: Sequence[str], count: str = "n", share: str = "percentage") -> DataFrame:
    """Rows per group and their percentage of all grouped rows; the rows are read once."""
    sizes = cut(group_size(df, keys, count), "sizes")
    total = sizes.agg(F.sum(count).alias("total")).scalar()
    return sizes.withColumn(share, rate(F.col(count), total) * 100)


def pivot_count(
    df: DataFrame, rows: str, columns: str, values: Sequence[object] | None = None, limit: int = PIVOT_LIMIT
) -> DataFrame:
    """Count table of ``rows`` by ``columns``; combinations never seen are NULL.

    Without ``values`` the column levels are read first, and more than ``limit`` of them are refused.
    """
    known = df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    if values is None:
        values = levels_of(known, columns, limit)
    return known.groupBy(rows).pivot(columns, list(values)).agg(F.count(F.lit(1)))


def levels_of(df: DataFrame, column: str, limit: int = PIVOT_LIMIT) -> list[object]:
    """Sorted distinct values of a column that is known to have few."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} levels")
    return sorted(r[0] for r in found)


def in_given_order(column: Column, order: Sequence[object]) -> Column:
    """Rank of a value in a declared order (1 first, 0 when not listed)."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), column)


def segment_lift(df: DataFrame, segment: str, label: str) -> DataFrame:
    """Rows, positives and rate for ``segment = 1`` against everything else."""
    return df.groupBy(F.col(segment).eqNullSafe(F.lit(1)).alias("in_segment")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(label).cast("long")).alias("positives"),
        rate(F.sum(label), F.count(F.lit(1))).alias("positive_rate"),
    )
