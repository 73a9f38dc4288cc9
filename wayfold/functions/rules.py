"""Ordered rule lists turned into CASE expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions: Iterable[Column]) -> Column:
    """OR of the conditions."""
    return reduce(or_, conditions)


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule whose condition is true, else ``default``."""
    out = F
    for condition, value in rules:
        out = out.when(condition, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def like_any(column: Column, patterns: str | Sequence[str]) -> Column:
    """Case-sensitive LIKE against one pattern or any of several."""
    if isinstance(patterns, str):
        return column.like(patterns)
    return any_of(column.like(p) for p in patterns)


def classify_like(column: Column, rules: Sequence[tuple[str | Sequence[str], str]]) -> Column:
    """Label of the first LIKE rule that matches; NULL when none does."""
    return first_match([(like_any(column, patterns), label) for patterns, label in rules])


def map_values(column: Column, mapping: Mapping[object, object]) -> Column:
    """Exact value to code; NULL for a value the mapping lacks."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.when(column.isNotNull(), F.try_element_at(F.create_map(*pairs), column))


def flag(condition: Column) -> Column:
    """1 where the condition is true, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def sql_case(rules: Sequence[tuple[str, str]], default: str = "NULL") -> str:
    """The CASE text of ordered (condition, value) SQL fragments."""
    arms = " ".join(f"WHEN {condition} THEN {value}" for condition, value in rules)
    return f"CASE {arms} ELSE {default} END"
