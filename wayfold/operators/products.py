"""Products of the sets of a key, dealt evenly by output number.

Joining several tables on one key gives every combination of the key's rows. A join keeps all
combinations of a key in the task of that key, so one busy key holds up the job. Here the sets are
gathered once, every combination has a number, and ranges of numbers are dealt over all tasks; a
row finds its members by the digits of its number in the mixed radix of the set sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.storage import cut

#: Members of one set that a task holds together, about: larger sets are split into blocks.
BLOCK = 256
#: Combinations per dealt range, about.
ROWS = 4096


def _times(values: str) -> str:
    return f"aggregate({values}, 1L, (a, x) -> a * x)"


def product_of_sets(
    items: DataFrame, keys: Sequence[str], slots: Sequence[str], block: int = BLOCK, rows: int = ROWS
) -> DataFrame:
    """(keys, one column per slot): every combination of one item from each of a key's sets.

    ``items`` has the keys, ``slot`` (a name of ``slots``) and ``item`` (any type that can be sorted).
    Repeated items count once, an empty set gives null, and a row with a null slot only makes its key
    known. Null keys are a key of their own. The result equals outer joins of the sets, in no order.

    Sets of more than about ``block`` items are split by hash, and each combination of blocks is a unit
    of its own; units of more than ``rows`` combinations are dealt in ranges. A task so holds at most one
    block per slot at a time. More than 2^63 combinations of one key raise an error.
    """
    keys, n_slots = list(keys), len(slots)
    items = cut(items.select(*keys, "slot", "item").distinct(), "set-items")
    sizes = items.groupBy(*keys).agg(F.array(*[F.count_if(F.col("slot") == s) for s in slots]).alias("sizes"))
    shaped = sizes.withColumn("blocks", F.expr(f"transform(sizes, n -> greatest(1L, ceil(n / {block})))")).withColumn(
        "filled", F.expr("zip_with(sizes, blocks, (n, b) -> ceil(n / b))")
    )
    # Only keys with more than one unit of work are told apart; all others are one row each.
    large = cut(
        shaped.select(
            *[F.col(k).alias(f"__{k}") for k in keys], "sizes", "blocks", F.expr(_times("blocks")).alias("units"),
            F.expr(f"ceil({_times('transform(filled, n -> greatest(n, 1L))')} / {rows})").alias("ranges"),
        ).where((F.col("units") > 1) | (F.col("ranges") > 1)),
        "large-keys",
    )
    same = reduce(lambda a, b: a & b, [items[k].eqNullSafe(large[f"__{k}"]) for k in keys])
    one = F.lit(1).cast("long")
    known = (
        items.join(large, same, "left")
        .select(*[items[k] for k in keys], "slot", "item", "sizes", "blocks",
                F.coalesce("units", one).alias("units"), F.coalesce("ranges", one).alias("ranges"),
                F.coalesce(F.array_position(F.lit(list(slots)), F.col("slot")), F.lit(0)).cast("int").alias("at"))
        .withColumn("own", F.when(F.col("at") > 0, F.coalesce(F.get("blocks", F.col("at") - 1), one)))
        .withColumn("stride", F.when(F.col("at") > 1, F.coalesce(F.expr(_times("slice(blocks, 1, at - 1)")), one)).otherwise(one))
        .withColumn("mine", F.pmod(F.xxhash64("item"), F.col("own")))
    )
    # A block takes part in every unit whose digit at its slot is its number, and in all ranges of those.
    shares = F.when(F.col("own").isNull(), one).otherwise(F.expr("units div own * ranges"))
    dealt = (
        known.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
        .withColumn("range", F.expr("copy % ranges"))
        .withColumn("unit", F.when(F.col("own").isNull(), F.lit(0).cast("long")).otherwise(F.expr(
            "copy div ranges div stride * stride * own + mine * stride + copy div ranges % stride")))
    )
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A fixed number of partitions: few bytes here become many rows, so sizes must not merge the parts.
    held = [f"__set_{i}" for i in range(n_slots)]
    gathered = (
        dealt.repartition(parts, *keys, "unit", "range")
        .groupBy(*keys, "unit", "range")
        .agg(
            # Sorted, because every range of a unit has to count its sets in the same order.
            *[F.sort_array(F.collect_list(F.when(F.col("slot") == s, F.col("item")))).alias(h) for s, h in zip(slots, held, strict=True)],
            F.first("ranges").alias("ranges"),
            F.first("sizes").alias("sizes"),
        )
    )
    # A hash can leave a block of a set empty; a unit with such a block has no combination.
    whole = "forall(zip_with(found, coalesce(sizes, found), (f, n) -> f > 0 or n = 0), ok -> ok)"
    counted = (
        gathered.withColumn("found", F.expr(f"array({', '.join(f'cast(size({h}) as long)' for h in held)})"))
        .where(whole)
        .withColumn("base", F.expr("transform(found, n -> greatest(n, 1L))"))
        .withColumn("strides", F.expr(f"transform(sequence(0, {n_slots - 1}), i -> {_times('slice(base, 1, i)')})"))
        .withColumn("total", F.expr(_times("base")))
        .withColumn("low", F.expr("total div ranges * range + least(range, total % ranges)"))
        .withColumn("high", F.expr("low + total div ranges + if(range < total % ranges, 1, 0)"))
        .where("high > low")
        .withColumn("number", F.explode(F.sequence("low", F.col("high") - 1)))
    )
    at = lambda i: f"cast(number div strides[{i}] % base[{i}] as int)"
    return counted.selectExpr(*[f"`{k}`" for k in keys], *[f"get({h}, {at(i)}) AS `{s}`" for i, (s, h) in enumerate(zip(slots, held, strict=True))])
