"""Numbering, running totals and leads inside groups of any size.

A window sorts each group in one task. That is right for ordinary groups and
wrong for a member or score that holds a large share of all rows. The functions
here measure the largest group first. Small groups take the plain window; if
any group is larger than ``limit`` the frame is range-partitioned on (keys,
order), which spreads a large group over many partitions, and each partition is
offset by the totals of the ones before it. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.storage import cut

GROUP_LIMIT = 2_000_000

_PART = "__part"


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; one partial aggregation, one value returned."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else df.agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def fits_one_task(df: DataFrame, keys: Sequence[str], limit: int | None) -> bool:
    """Whether no group has more than ``limit`` rows; no limit means known to fit."""
    return limit is None or largest_group(df, keys) <= limit


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    measures: Mapping[str, Column],
    limit: int | None = GROUP_LIMIT,
) -> DataFrame:
    """Add inclusive running sums of ``measures`` within ``keys`` in ``order``."""
    keys = list(keys)
    if fits_one_task(df, keys, limit):
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumns({name: F.sum(m).over(w) for name, m in measures.items()})
    return _split_running_totals(df, keys, order, measures, limit)


def _split_running_totals(df, keys, order, measures, limit):
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * (df.count() // limit) + 1)
    placed = cut(
        df.withColumns({f"__m_{name}": m for name, m in measures.items()})
        .repartitionByRange(parts, *[F.col(k) for k in keys], *order)
        .withColumn(_PART, F.spark_partition_id()),
        "ranged",
    )
    sums = {name: F.sum(f"__m_{name}") for name in measures}
    # One row per (partition, key): only keys that run over a partition edge
    # have an earlier partition, so at most ``parts`` offset rows are kept.
    earlier = W.partitionBy(*keys).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(_PART, *keys)
        .agg(*[s.alias(f"__t_{name}") for name, s in sums.items()])
        .withColumns({f"__o_{name}": F.sum(f"__t_{name}").over(earlier) for name in measures})
        .withColumn("__prior", F.count(F.lit(1)).over(earlier))
        .where(F.col("__prior") > 0)
        .select(_PART, *keys, *[f"__o_{name}" for name in measures])
    )
    joined = placed.join(F.broadcast(offsets), _same(placed, offsets, [_PART, *keys]), "left")
    within = (
        W.partitionBy(placed[_PART], *[placed[k] for k in keys])
        .orderBy(*order)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return joined.select(
        *[placed[c] for c in df.columns],
        *[
            (F.sum(f"__m_{name}").over(within) + F.coalesce(F.col(f"__o_{name}"), F.lit(0))).alias(name)
            for name in measures
        ],
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn", limit: int | None = GROUP_LIMIT
) -> DataFrame:
    """Number the rows of each group from 1 in ``order`` (give a unique order)."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("long")}, limit)


def leads(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    columns: Sequence[str],
    steps: Sequence[int] = (1, 2),
    limit: int | None = GROUP_LIMIT,
) -> DataFrame:
    """Add ``<column>_lead<n>``: the value ``n`` rows later in the group."""
    if fits_one_task(df, keys, limit):
        w = W.partitionBy(*keys).orderBy(*order)
        return df.withColumns({f"{c}_lead{n}": F.lead(c, n).over(w) for n in steps for c in columns})
    # Large groups: number the rows, offer each one to the rows ``n`` places
    # before it, and gather by (key, place), which is unique and never skewed.
    numbered = number_rows(df, keys, order, "__place", limit)
    offers = numbered.select(
        "*", F.explode(F.array(*[F.lit(n) for n in (0, *steps)])).alias("__step")
    ).withColumn("__slot", F.col("__place") - F.col("__step"))
    own = [c for c in df.columns if c not in keys]
    at = lambda n, c: F.max(F.when(F.col("__step") == n, F.col(c)))
    return (
        offers.where("__slot > 0")
        .groupBy(*keys, "__slot")
        .agg(
            *[at(0, c).alias(c) for c in own],
            *[at(n, c).alias(f"{c}_lead{n}") for n in steps for c in columns],
        )
        .select(*df.columns, *[f"{c}_lead{n}" for n in steps for c in columns])
    )


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, number: str | None = None
) -> DataFrame:
    """The first ``n`` rows of every group.

    ``row_number() <= n`` lets Spark keep only ``n`` rows per group in every map
    task before the shuffle, so the size of a group does not matter.
    """
    name = number or "__rn"
    kept = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return kept if number else kept.drop(name)
