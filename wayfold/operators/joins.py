"""Join operators.

No side is broadcast by hint unless its size is bounded by construction; for
all others the planner decides from sizes, and adaptive execution splits skewed
partitions of the fact side. It can only do so between two plain shuffles, so a
lookup that is the result of an aggregation is stored before rows with possibly
hot keys are joined to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.storage import cut


def inner(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-join."""
    return left.join(right, list(keys), "inner")


def left_outer(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi-join to a side with at most a few rows per key."""
    return left.join(right, list(keys), "left")


def left_outer_many(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi-join to an unaggregated side, which repeats left rows.

    One key may hold much of ``right``. A left join cannot split that side, an
    inner join can; so matched rows come from an inner join and the others from
    an anti join against the distinct keys.
    """
    matched = left.join(right, list(keys), "inner")
    others = left.join(right.select(*keys).distinct(), list(keys), "left_anti")
    return matched.unionByName(others, allowMissingColumns=True)


def semi_in(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    return left.join(right, list(keys), "left_semi")


def complement(whole: DataFrame, part: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``whole`` whose key is not in ``part``."""
    return whole.join(part, list(keys), "left_anti")


def distinct_keys(frames: Sequence[DataFrame]) -> DataFrame:
    """Distinct rows of several key lists."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def membership_flags(
    df: DataFrame, key: str, members: DataFrame, flags: dict[str, Column], member_key: str
) -> DataFrame:
    """Several 0/1 flags from one keyed list, in one join that never repeats rows.

    ``members`` may hold a key many times; each flag is 1 when any of the key's
    rows meets the flag's condition.
    """
    one = members.where(F.col(member_key).isNotNull()).groupBy(F.col(member_key).alias(key)).agg(
        *[F.max(F.when(c, 1).otherwise(0)).alias(name) for name, c in flags.items()]
    )
    return df.join(one, key, "left").withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in flags})


def between_days(day: Column, start: Column, before: int, after: int) -> Column:
    """``day`` within ``start - before`` and ``start + after``, both ends in."""
    return day.between(F.date_sub(start, before), F.date_add(start, after))


def within_days(
    events: DataFrame, spans: DataFrame, keys: Sequence[str], day: str, start: str, before: int, after: int
) -> DataFrame:
    """Equi-join with a closed day range around ``start`` as residual."""
    return events.join(spans, list(keys)).where(between_days(F.col(day), F.col(start), before, after))


def dimension_default(
    df: DataFrame, dim: DataFrame, key: str, dim_key: str, attribute: str, default: str
) -> DataFrame:
    """Attach one attribute of a lookup; unmatched rows get ``default``."""
    lookup = dim.select(F.col(dim_key).alias(key), attribute)
    return df.join(lookup, key, "left").withColumn(attribute, F.coalesce(F.col(attribute), F.lit(default)))


def fill_from_lookup(df: DataFrame, lookup: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Fill only the null cells of ``columns`` from a stored keyed table, in one join."""
    renamed = lookup.select(key, *[F.col(c).alias(f"__fill_{c}") for c in columns])
    return (
        df.join(renamed, key, "left")
        .withColumns({c: F.coalesce(F.col(c), F.col(f"__fill_{c}")) for c in columns})
        .select(*df.columns)
    )


def aggregate_back(df: DataFrame, aggregated: DataFrame, key: str) -> DataFrame:
    """Attach per-group values to every row; a null key keeps null values."""
    return df.join(cut(aggregated.where(F.col(key).isNotNull()), "lookup"), key, "left")
