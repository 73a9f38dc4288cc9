"""Exact duplicates through a two-pass Bloom filter, in DataFrame operations only.

Pass one sends nothing but cell numbers: each row's digest picks ``HASHES`` cells of a
filter of ``bits`` cells, cells are counted (combined before the shuffle), and cells
seen twice or more become bitmaps. Pass two tests every row against them. A row with a
cell seen once has no equal and passes straight through; the rest, and only they, shuffle
by digest. A full filter lets more rows shuffle and never changes a result.

The filter is broadcast: it holds at most ``bits`` / 8 bytes whatever the input, plus a few
bytes for each of its ``bits`` / 32768 rows.

Null text counts as empty, so empty and null texts are equal. A null id sorts after all
others; rows with equal text and equal id are the same document: both are marked as
kept, and ``drop_copies`` leaves one of them. Extra columns pass through untouched,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.storage import cut

HASHES = 2
BITS = 1 << 25
_MAP_SHIFT = 15
_MAP_CELLS = 1 << _MAP_SHIFT


def normal_digest(text: Column) -> Column:
    """Hex SHA-256 of the text with each run of white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


def _cells(digest: Column, bits: int) -> list[Column]:
    """The cells of a hex digest: eight hex digits each."""
    return [
        F.pmod(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long"), F.lit(bits)) for k in range(HASHES)
    ]


def repeated_cells(rows: DataFrame, digest: str, bits: int = BITS, least: int = 2) -> DataFrame:
    """Pass one: (map, cells) bitmaps of the filter cells that rows hit at least ``least`` times."""
    cell = F.explode(F.array(*_cells(F.col(digest), bits))).alias("cell")
    twice = rows.select(cell).groupBy("cell").count().filter(F.col("count") >= least)
    return twice.groupBy(F.shiftright("cell", _MAP_SHIFT).alias("map")).agg(
        F.bitmap_construct_agg(F.col("cell").bitwiseAND(_MAP_CELLS - 1)).alias("cells")
    )


def maybe_repeated(rows: DataFrame, digest: str, filters: DataFrame, flag: str, bits: int = BITS) -> DataFrame:
    """Pass two: add ``flag``, false only where no other row has the same digest."""
    names, hits = rows.columns, []
    for k, cell in enumerate(_cells(F.col(digest), bits)):
        side = F.broadcast(filters.select(F.col("map").alias(f"__map{k}"), F.col("cells").alias(f"__cells{k}")))
        rows = rows.join(side, F.shiftright(cell, _MAP_SHIFT) == F.col(f"__map{k}"), "left")
        number = cell.bitwiseAND(_MAP_CELLS - 1)
        byte = F.substring(F.col(f"__cells{k}"), (F.shiftright(number, 3) + 1).cast("int"), F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        hits.append(F.coalesce(F.getbit(value, number.bitwiseAND(7).cast("int")) == 1, F.lit(False)))
    return rows.select(*names, reduce(lambda a, b: a & b, hits).alias(flag))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), normal_digest(F.col(text_col)).alias("text_sha256")), "digest")
    flagged = maybe_repeated(rows, "text_sha256", repeated_cells(rows, "text_sha256", bits), "maybe", bits)
    flagged = cut(flagged, "flagged")
    alone = flagged.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256"
    )
    some = flagged.filter("maybe").drop("maybe")
    # Stored, so that both sides of the join are plain shuffles and a hot digest can be split.
    groups = cut(some.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    shared = some.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
    out = alone.unionByName(shared).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """The documents without copies, with all their columns: of equal texts the smallest id stays.

    Rows that cannot have an equal are not shuffled. Of the others, the smallest id per
    digest is found first (combined before the shuffle) and only rows with that id are
    carried on; a group whose copies repeat that very id ends as one row.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), normal_digest(F.col(text_col)).alias("digest"))
    filters = cut(repeated_cells(rows.select("digest"), "digest", bits), "cells")
    flagged = maybe_repeated(rows, "digest", filters, "maybe", bits)
    alone = flagged.filter(~F.col("maybe")).select("row.*")
    some = flagged.filter("maybe")
    first = cut(some.groupBy("digest").agg(F.min("id").alias("first")), "first")
    last = some.join(first, "digest").filter(F.col("first").eqNullSafe(F.col("id")))
    return alone.unionByName(last.dropDuplicates(["digest"]).select("row.*"))
