"""Products of sets against nested loops, whole and split."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators.products import product_of_sets

SLOTS = ("a", "b", "c")


def by_loops(lines):
    sets = {}
    for key, slot, value in lines:
        mine = sets.setdefault(key, {s: set() for s in SLOTS})
        if slot in mine:
            mine[slot].add(value)
    found = []
    for key, mine in sets.items():
        found += [(key, *combo) for combo in itertools.product(*[sorted(mine[s], key=repr) or [None] for s in SLOTS])]
    return sorted(found, key=repr)


def lines_of(seed):
    dice = random.Random(seed)
    lines = [(1, s, v) for s, n in (("a", 23), ("b", 7), ("c", 3)) for v in range(n)]
    lines += [(2, None, None), (None, "a", 1), (None, "c", 2), (3, "b", 5), (3, "b", 5), (3, None, None)]
    lines += [(dice.randrange(4, 40), dice.choice(SLOTS), dice.randrange(9)) for _ in range(200)]
    return lines


@pytest.mark.parametrize(("block", "most"), [(256, 4096), (4, 4096), (256, 5), (2, 3), (1, 1)])
def test_equals_nested_loops(spark, block, most):
    lines = lines_of(block)
    items = spark.createDataFrame(lines, "k int, slot string, v int").select(
        "k", "slot", F.when(F.col("slot").isNotNull(), F.col("v")).alias("item")
    )
    out = product_of_sets(items, ["k"], SLOTS, block, most)
    assert out.columns == ["k", *SLOTS]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == by_loops(lines)


def test_empty_table(spark):
    items = spark.createDataFrame([], "k int, slot string, item int")
    assert product_of_sets(items, ["k"], SLOTS).count() == 0


def test_one_hot_key_is_dealt_to_all_tasks(spark):
    items = spark.range(300).select(F.lit(1).alias("k"), F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("slot"), F.struct("id").alias("item"))
    out = product_of_sets(items, ["k"], ("a", "b"), rows=256)
    shares = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(shares) == 150 * 150
    assert max(shares) < sum(shares) / 2
