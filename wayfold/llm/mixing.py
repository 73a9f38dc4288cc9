"""Mixing sources along a curriculum, in DataFrame operations only.

Every source gets a target of words, and a curve of weights over training time from 0 to 1. The
curve's integral, scaled to the target, is the source's cumulative demand. A source's documents
stand in the order of their ids' digests, each over the words before it; a second pass over
the source follows the first. The word at which a document starts is inverted through the cumulative
demand to the time at which training asks for it, and sorting by that time gives the mix.

Targets: sources share ``SHARE`` of all words by weight, none above ``MOST`` times its own size; what
a full source leaves is shared again by weight. That is one water level over sources in the order
of size by weight, so prefix sums find it without a loop.

Words before a document: documents fall into cells by the first digits of their digest, as many as
keep a cell at about ``CELL_ROWS`` rows however large a source is. Cell totals are summed first
and give each cell its offset; only within a cell rows are ordered. So a source with most of
the rows is many small groups. The document that reaches past the target is taken up to it, so
a source's words taken are its target's whole words exactly.

Null text has size 0. A null source is a source of its own and the last one. Documents of size 0 are
never taken. Rows that agree in source, id and size stand next to each other in any order, which
gives the same rows. A null id has the digest of an empty text. Extra columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.storage import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
CELL_ROWS = 1 << 12
#: Weight at the beginning and the end of training for the sources of each weight class: strong sources early,
#: weak ones late.
CURVES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def word_count(text: Column) -> Column:
    """Runs of anything but space and the control characters 9 to 13."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    # One character a word stays.
    marks = F.regexp_replace(inner, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.length(marks).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("cell"), digest.alias("digest"),
    )
    return cut(rows, "sizes")


def _pick(number: Column, values: Sequence[float]) -> Column:
    """The value at a position of a repeating list."""
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add number, weight and target to (source, source_size), one row a source."""
    # One row a source: its rows were added up before.
    numbered = sources.withColumn("number", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = numbered.withColumns({"weight": _pick(F.col("number"), weights).cast("double"), "most": F.lit(float(most)) * F.col("source_size")})
    by_level = W.orderBy(F.col("most") / F.col("weight"), "number")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    from_here = by_level.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    left = F.sum(F.lit(float(share)) * F.col("source_size")).over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = weighed.withColumn("level", left / F.sum("weight").over(from_here))
    # The first source that the level does not fill has the level of all after it.
    open_level = F.min(F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("number"), F.col("level")))).over(everything)
    reached = F.coalesce(open_level["level"] * F.col("weight"), F.col("most"))
    return level.select("source", "source_size", "number", F.least(F.col("most"), reached).alias("target"))


def _time(words: Column, target: Column, start: Column, end: Column) -> Column:
    """When a curve of straight weight from ``start`` to ``end``, integrated to ``target``, has asked for so many words."""
    # With y = words / target and both weights adding up to 2: start t + (end - start) t^2 / 2 = y.
    y = words / target
    return F.lit(2.0) * y / (start + F.sqrt(start * start + F.lit(2.0) * (end - start) * y))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    curves: Sequence[tuple[float, float]] = CURVES,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, taken, and the time of each of its copies.

    The rows are range-sorted by the time at which training first asks for them; those never taken are last.
    ``position`` is the time of the first copy and ``again`` that of the second, null where the copy is not taken.
    A curve is the weight at the beginning and at the end of training; the two are scaled to add up to 2, which makes
    their integral 1. ``most`` is at most 2.
    """
    rows = _sized(docs, id_col, text_col, source_col)
    rows_of_all = rows.count()
    cells = 1
    while cells * cell_rows < rows_of_all and cells < 1 << 31:
        cells *= 2
    rows = rows.withColumn("cell", F.floor(F.col("cell") / F.lit((1 << 32) // cells)))
    # Sums per cell, then per source: at most a row for each cell of each source.
    totals = cut(rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")), "cells")
    goals = cut(targets(totals.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, most), "targets")
    earlier = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut(totals.withColumn("ahead", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0))).drop("cell_size"), "offsets")
    inside = W.partitionBy("source", "cell").orderBy("digest", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    known = placed.join(offsets, same(placed, offsets, "source", "cell")).drop(offsets["source"], offsets["cell"])
    joined = known.join(goals, known["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    scaled = [(2 * a / (a + b), 2 * b / (a + b)) for a, b in curves]
    start, end = (_pick(F.col("number"), [c[k] for c in scaled]) for k in (0, 1))
    whole = F.floor("target").cast("long")
    first = F.col("ahead") + F.col("before")
    overlap = lambda at: F.greatest(F.lit(0), F.least(at + F.col("size"), whole) - at)
    second = first + F.col("source_size")
    when = lambda at: F.when(overlap(at) > 0, _time(at.cast("double"), F.col("target"), start, end))
    timed = joined.select(
        "doc_id", "size", "source", "source_size", "target",
        (overlap(first) + overlap(second)).cast("long").alias("taken"),
        when(first).alias("position"), when(second).alias("again"),
    )
    return timed.orderBy(F.col("position").asc_nulls_last(), "source", "doc_id", "size", "again")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy that is taken, range-sorted by its time: doc_id, source, copy, position."""
    copies = mixed.select("doc_id", "source", F.posexplode(F.array("position", "again")).alias("copy", "position"))
    return copies.where("position IS NOT NULL").orderBy("position", "source", "doc_id", "copy")


#: The same rows in SQL: the level of the targets by trying every source as the first that stays below its limit.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE number % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS most FROM s
), v AS (
  SELECT (1.5::DOUBLE * (SELECT sum(source_size) FROM w) - coalesce((SELECT sum(b.most) FROM w b WHERE (b.most / b.weight, b.number) < (a.most / a.weight, a.number)), 0))
         / (SELECT sum(b.weight) FROM w b WHERE (b.most / b.weight, b.number) >= (a.most / a.weight, a.number)) AS level, a.*
  FROM w a
), g AS (
  SELECT source, source_size, number,
         least(most, coalesce((SELECT level FROM v x WHERE x.level * x.weight < x.most ORDER BY x.most / x.weight, x.number LIMIT 1) * weight, most)) AS target
  FROM v
), p AS (
  SELECT doc_id, size, d.source, source_size, target, number,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), t AS (
  SELECT *, greatest(0, least(a + size, CAST(floor(target) AS BIGINT)) - a) AS one,
         greatest(0, least(a + source_size + size, CAST(floor(target) AS BIGINT)) - a - source_size) AS two FROM p
), y AS (
  SELECT *, a / target AS y1, (a + source_size) / target AS y2 FROM t
)
SELECT doc_id, size, source, source_size, target, CAST(one + two AS BIGINT) AS taken,
       CASE WHEN one > 0 THEN round(2 * y1 / (CASE number % 3 WHEN 0 THEN 1.5 + sqrt(2.25 - 2 * y1) WHEN 1 THEN 2 ELSE 0.5 + sqrt(0.25 + 2 * y1) END), 9) END AS position,
       CASE WHEN two > 0 THEN round(2 * y2 / (CASE number % 3 WHEN 0 THEN 1.5 + sqrt(2.25 - 2 * y2) WHEN 1 THEN 2 ELSE 0.5 + sqrt(0.25 + 2 * y2) END), 9) END AS again
FROM y
"""
