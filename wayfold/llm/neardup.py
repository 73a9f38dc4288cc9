"""Near duplicates by BagMinHash signatures, bands and verified multiset overlap.

A document is the multiset of its runs of five words (all its words, when it has fewer).
Two are linked when their weighted Jaccard similarity, the sum of the smaller over the sum
of the larger multiplicities, is at least ``THRESHOLD``; classes are what links connect.

Signatures. Each element owns Poisson processes over its weight, which is a whole number:
one over [0, 1) and one over each [2^j, 2^(j+1)) that the weight reaches, each with the
interval's length as its rate. A point has a time, a slot and a weight level, all drawn
from hashes of element, interval and index, and counts only when its level is below the
weight, so texts share a point exactly as far as their weights overlap. A slot keeps the
identity of its earliest point. Two texts agree in a slot with probability equal to their
weighted Jaccard similarity. Points are made in order of time and only up to the time by
which every slot is taken, so a text costs one draw per element and a fixed number of
points besides.

Candidates. Texts with equal words are one node from the start. ``BANDS`` bands of ``ROWS``
slots put nodes into buckets; a pair at the threshold shares a bucket with probability
1 - (1 - 0.8^6)^32 = 0.9999. In a bucket no pairs are listed at first: all members are
compared with one hub (the member with the smallest hash), so a group of copies costs one
comparison a member. Where a bucket then still has several classes, members that hold too many
elements of their own to be linked to anything leave it, by counting. The rest are compared with each other,
block against block, by one matrix product for two blocks. So each pair of a bucket is verified, already
connected, or proven to be no link.

Verification counts the common runs of five words of the whole texts by 64-bit hashes.

Null and empty texts have no words: they are equal to each other and to nothing else. A
class is named by its smallest id (null when it has none but null ids); ``without_copies``
keeps one row of it, that with the smallest id. Repeated rows are copies. Extra columns
pass through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from wayfold.llm.exact import maybe_repeated, repeated_cells
from wayfold.llm.words import hashed_words, mixed, runs, tidy
from wayfold.storage import cut

WIDTH = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 6
SLOTS = BANDS * ROWS
#: Texts of a block, and unit elements of a product, when a bucket's members are compared with each other.
BLOCK = 256
CHUNK = 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bags(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, weight) of each row's multiset of runs, by row and element."""
    shingles, n = runs(hashes, counts, WIDTH)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((shingles, row))
    row, shingles = row[order], shingles[order]
    if len(row) == 0:
        return row, shingles, row
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingles[1:] != shingles[:-1])
    at = np.flatnonzero(new)
    return row[at], shingles[at], np.diff(np.append(at, len(row)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / float(1 << 53)


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """The identities of the earliest points: uint64 of shape (rows, SLOTS); 0 in rows without elements."""
    out = np.zeros((rows, SLOTS), np.uint64)
    if len(row) == 0:
        return out
    total = np.bincount(row, weight, rows)
    todo = np.flatnonzero(total > 0)
    margin = 2.0
    while len(todo):
        limit = np.zeros(rows)
        limit[todo] = SLOTS * (np.log(SLOTS) + margin) / total[todo]
        open_ = limit[row] > 0
        slot, time, identity = _points(row[open_], element[open_], weight[open_], limit)
        order = np.lexsort((time, slot))
        slot, identity = slot[order], identity[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        out.reshape(-1)[slot[first]] = identity[first]
        full = np.bincount(slot[first] // SLOTS, minlength=rows) == SLOTS
        out[todo[~full[todo]]] = 0
        todo, margin = todo[~full[todo]], margin + 6.0
    return out


def _points(row, element, weight, limit):
    """All counting points up to each row's time limit: (row * SLOTS + slot, time, identity)."""
    found, level = [], 0
    low, high = 0, 1
    while len(row):
        rate = float(high - low)
        with np.errstate(over="ignore"):
            seed = mixed(element + np.uint64(level + 1) * _STEP)
        r, w, s, t, index = row, weight, seed, np.zeros(len(row)), 0
        batch = 1
        while len(r):
            steps = np.arange(index, index + batch, dtype=np.uint64)
            with np.errstate(over="ignore"):
                draw = mixed(s[:, None] + (steps[None, :] + np.uint64(1)) * _STEP)
                other = mixed(draw ^ _STEP)
            times = t[:, None] + np.cumsum(-np.log(_unit(draw)) / rate, axis=1)
            good = times <= limit[r][:, None]
            if high - low > 1:
                good &= low + (_unit(mixed(other ^ np.uint64(level))) * (high - low)) <= w[:, None]
            where = np.nonzero(good)
            slot = (other[where] % np.uint64(SLOTS)).astype(np.int64)
            found.append((r[where[0]] * SLOTS + slot, times[where], draw[where]))
            more = times[:, -1] <= limit[r]
            r, w, s, t = r[more], w[more], s[more], times[more, -1]
            index, batch = index + batch, min(batch * 2, 256)
        level, low, high = level + 1, high, high * 2
        deeper = weight > low
        row, element, weight = row[deeper], element[deeper], weight[deeper]
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def band_keys(table: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band, the band's number mixed in."""
    keys = np.zeros((len(table), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            keys = mixed((keys ^ table[:, k::ROWS]) + _STEP)
        return mixed(keys + np.arange(BANDS, dtype=np.uint64) * _STEP)


def _nodes(column: pa.Array):
    """Per group of rows: (first row, end row, identity of each row's words, hashes, counts)."""
    for first, end, hashes, counts in hashed_words(column):
        at = np.concatenate([[0], np.cumsum(counts)])
        node = [hashlib.blake2b(hashes[at[k] : at[k + 1]].tobytes(), digest_size=16).digest() for k in range(end - first)]
        yield first, end, node, hashes, counts


def _sign(batches):
    for batch in batches:
        for first, end, node, hashes, counts in _nodes(batch.column(1)):
            row, element, weight = bags(hashes, counts)
            keys = band_keys(signatures(row, element, weight, end - first)).view(np.int64)
            ends = np.cumsum(np.where(counts > 0, BANDS, 0))
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(keys[counts > 0].reshape(-1)))
            columns = [batch.column(0).slice(first, end - first), pa.array(node, pa.binary()), bands]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "bands"])
    tidy()


def _named(place: int):
    """Add each row's node as the last column; the text is a field of the struct that is the second column."""

    def run(batches):
        for batch in batches:
            node = [n for _, _, some, _, _ in _nodes(batch.column(1).field(place)) for n in some]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.binary())], [*batch.schema.names, "node"])
        tidy()

    return run


def similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of two text columns, row by row."""
    out = np.zeros(len(left))
    sides = [_bags_of(left), _bags_of(right)]
    for k, ((a, n), (b, m)) in enumerate(zip(*sides, strict=True)):
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        common = int(np.minimum(n[i], m[j]).sum())
        union = int(n.sum() + m.sum()) - common
        out[k] = common / union if union else 1.0
    return out


def _bags_of(column: pa.Array):
    for first, end, hashes, counts in hashed_words(column):
        row, element, weight = bags(hashes, counts)
        at = np.searchsorted(row, np.arange(end - first + 1))
        for k in range(end - first):
            yield element[at[k] : at[k + 1]], weight[at[k] : at[k + 1]]


def _verify(batches):
    for batch in batches:
        near = similarity(batch.column("left_text"), batch.column("right_text")) >= THRESHOLD
        yield batch.select(["a", "b"]).filter(pa.array(near))
    tidy()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of the nodes on ``edges`` (a, b): the smallest node each is connected to.

    Every node takes the smallest label among itself and its neighbours; after two rounds, which are
    enough around hubs, also the label of that label, which halves the rounds of long chains. Each round is
    written to the shared folder, and the last one changes nothing.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{label}-edges")
    roots = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), label)
    turn = 0
    while True:
        told = both.join(roots, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "root", F.lit(None).cast("binary").alias("old"))
        own = roots.select("node", "root", F.col("root").alias("old"))
        after = told.unionByName(own).groupBy("node").agg(F.min("root").alias("root"), F.max("old").alias("old"))
        if turn >= 2:
            after = cut(after, label)
            jump = after.select(F.col("node").alias("at"), F.col("root").alias("next"))
            after = after.join(jump, F.col("root") == F.col("at")).select("node", F.least("root", "next").alias("root"), "old")
        after, turn = cut(after, label), turn + 1
        roots = after.select("node", "root")
        if after.where("old <> root").isEmpty():
            return roots


def _classes(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """``members`` with the class of each node so far."""
    if links is None:
        return members.withColumn("class", F.col("node"))
    roots = components(links).withColumnRenamed("node", "of")
    joined = members.join(roots, F.col("node") == F.col("of"), "left")
    return joined.withColumn("class", F.coalesce("root", "node")).drop("of", "root")


def _elements(batches):
    """(node, element, weight) of texts given as (node, text)."""
    for batch in batches:
        for node, (element, weight) in zip(batch.column(0).to_pylist(), _bags_of(batch.column(1)), strict=True):
            columns = [pa.array([node] * len(element), pa.binary()), pa.array(element.view(np.int64)), pa.array(weight.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "element", "weight"])
    tidy()


def _hopeful(members: DataFrame, texts: DataFrame) -> DataFrame:
    """The members of buckets that can be linked to anything there at all.

    Two texts of total weight m and n that are linked share at least T / (1 + T) of m + n, and n is at least T of m. An
    element that only one of all these texts holds is shared with none, so a text with too many of them is
    linked to nothing. In a large group of copies that differ here and there, this settles those that differ too
    much by counting, where comparing would need every pair.
    """
    nodes = members.select("node").distinct()
    held = texts.select("node", "text").join(nodes, "node", "left_semi").mapInArrow(_elements, "node binary, element long, weight long")
    held = cut(held, "elements")
    single = held.groupBy("element").agg(F.count("*").alias("holders"), F.first("node").alias("of"), F.first("weight").alias("weight"))
    alone = single.where("holders = 1").groupBy("of").agg(F.sum("weight").alias("alone"))
    sizes = held.groupBy("node").agg(F.sum("weight").alias("total")).join(alone, F.col("node") == F.col("of"), "left")
    sizes = cut(sizes.select("node", "total", (F.col("total") - F.coalesce("alone", F.lit(0))).alias("common")), "sizes")
    placed = cut(members.join(sizes, "node"), "placed")
    least = cut(placed.groupBy("key").agg(F.min("total").alias("smallest")), "smallest")
    other = F.greatest(F.col("smallest"), F.col("total") * F.lit(THRESHOLD))
    needed = (F.col("total") + other) * F.lit(THRESHOLD / (1 + THRESHOLD)) - F.lit(1e-6)
    return placed.join(least, "key").where(F.col("common") >= needed).select("key", "node", "u")


def _mixed(members: DataFrame, links: DataFrame | None) -> tuple[DataFrame, DataFrame, int]:
    """Members with their classes so far, the buckets (key, size, u0) of several classes, and the largest one's size."""
    now = cut(_classes(members, links), "classes")
    found = now.groupBy("key").agg(F.count("*").alias("size"), F.min("class").alias("c0"), F.max("class").alias("c1"), F.min("u").alias("u0"))
    buckets = cut(found.where("c0 < c1").select("key", "size", "u0"), "buckets")
    return now, buckets, buckets.agg(F.max("size")).first()[0] or 0


def _hub_links(left: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links of bucket members with their bucket's hub, the member with the smallest ``u``."""
    hub = left.where(F.col("u") == F.col("u0")).select("key", F.col("node").alias("a"))
    pairs = cut(left.join(hub, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "pairs")
    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left_text")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right_text")), "b")
    return cut(two.select("a", "b", "left_text", "right_text").mapInArrow(_verify, "a binary, b binary"), "links")


def overlaps(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """Common weight of every two rows, by products of their unit incidences; columns come in bounded chunks."""
    # An element of weight w is w unit elements (element, 1) to (element, w): common units are the smaller weight.
    level = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    row, element = np.repeat(row, weight), np.repeat(element, weight)
    _, unit, holders = np.unique(np.stack([element.view(np.int64), level]), axis=1, return_inverse=True, return_counts=True)
    unit = unit.reshape(-1)
    shared = holders[unit] > 1
    row, (_, unit) = row[shared], np.unique(unit[shared], return_inverse=True)
    order = np.argsort(unit, kind="stable")
    row, unit = row[order], unit[order]
    out = np.zeros((rows, rows), np.float64)
    edges = np.searchsorted(unit, np.arange(0, (unit[-1] if len(unit) else 0) + 1 + CHUNK, CHUNK))
    for at, end in zip(edges[:-1], edges[1:], strict=True):
        if end > at:
            dense = np.zeros((rows, CHUNK), np.float32)
            dense[row[at:end], unit[at:end] - unit[at] // CHUNK * CHUNK] = 1
            out += dense @ dense.T
    return out


def _block_links(key, table):
    """Links, enough to connect, between the texts of two blocks of a bucket that are not in one class yet."""
    nodes, classes = table.column("node").to_pylist(), table.column("class").to_pylist()
    found = list(_bags_of(table.column("text")))
    size = np.array([w.sum() for _, w in found], float)
    row = np.repeat(np.arange(len(found)), [len(e) for e, _ in found])
    common = overlaps(row, np.concatenate([e for e, _ in found]), np.concatenate([w for _, w in found]).astype(np.int64), len(found))
    near = common >= THRESHOLD * (size[:, None] + size[None, :] - common)
    root: dict[bytes, bytes] = {}

    def top(c):
        while root.get(c, c) != c:
            c = root[c]
        return c

    links = []
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        one, other = top(classes[i]), top(classes[j])
        if one != other:
            root[max(one, other)] = min(one, other)
            links.append((nodes[i], nodes[j]))
    return pa.table({"a": pa.array([x[0] for x in links], pa.binary()), "b": pa.array([x[1] for x in links], pa.binary())})


def _rest_links(left: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between all members of a bucket that are still in different classes, block against block.

    A member goes to one block by its hash and from there to a group for each block of its bucket; a group
    holds two blocks, about 2 * ``BLOCK`` texts, however large the bucket is.
    """
    blocks = F.ceil(F.col("size") / F.lit(BLOCK))
    own = F.pmod(F.xxhash64(F.lit(7), "node"), blocks)
    dealt = left.select("key", "node", "class", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    placed = dealt.join(texts, "node").select("key", "node", "class", "text", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    return cut(placed.groupBy("key", "x", "y").applyInArrow(_block_links, "a binary, b binary").distinct(), "links")


def _links(members: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Verified links (a, b) between nodes that share a bucket, enough to connect every linked pair."""
    now, buckets, largest = _mixed(members, None)
    if not largest:
        return None
    links = _hub_links(now.join(buckets, "key"), texts)
    now, buckets, largest = _mixed(members, links)
    if not largest:
        return links
    rest = cut(_hopeful(now.join(buckets, "key").select("key", "node", "u"), texts), "rest")
    now, buckets, largest = _mixed(rest, links)
    return links.unionByName(_rest_links(now.join(buckets, "key"), texts)) if largest else links


def _with_node(rows: DataFrame, text_col: str) -> DataFrame:
    """Add the identity of the words of a text that is in the struct of the second column."""
    place = rows.schema.fields[1].dataType.names.index(text_col)
    return rows.mapInArrow(_named(place), StructType([*rows.schema.fields, StructField("node", BinaryType())]))


def _texts_of(docs: DataFrame, text_col: str, members: DataFrame) -> DataFrame:
    """One (node, text) per node of ``members``; a Bloom filter keeps most other texts out of the shuffle."""
    wanted = members.select("node").distinct()
    filters = cut(repeated_cells(wanted.select(F.hex("node").alias("digest")), "digest", least=1), "cells")
    rows = _with_node(docs.select(F.lit(0).alias("x"), F.struct(F.col(text_col).alias("text")).alias("row")), "text")
    some = maybe_repeated(rows.select("row.text", "node", F.hex("node").alias("digest")), "digest", filters, "maybe").where("maybe")
    one = some.groupBy("node").agg(F.first("text").alias("text"))
    return cut(one.join(wanted, "node", "left_semi"), "texts")


def _node_classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored (id, node) of every document and (node, first, n, root) of every distinct text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = [rows.schema["id"], *StructType.fromDDL("node binary, bands array<bigint>").fields]
    signed = cut(rows.mapInArrow(_sign, StructType(kind)), "signed")
    nodes = cut(signed.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.first("bands").alias("bands")), "nodes")
    keyed = nodes.select(F.explode("bands").alias("key"), "node")
    shared = cut(keyed.groupBy("key").count().where("count > 1").select("key"), "shared")
    u = F.xxhash64("node") / F.lit(float(1 << 64)) + 0.5
    members = cut(keyed.join(shared, "key").withColumn("u", u), "members")
    links = _links(members, _texts_of(docs, text_col, members))
    if links is None:
        return signed, nodes.select("node", "first", "n", F.col("node").alias("root"))
    roots = components(links).select(F.col("node").alias("of"), "root")
    rooted = nodes.join(roots, F.col("node") == F.col("of"), "left")
    return signed, cut(rooted.select("node", "first", "n", F.coalesce("root", "node").alias("root")), "rooted")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept."""
    signed, nodes = _node_classes(docs, id_col, text_col)
    sizes = cut(nodes.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size")), "sizes")
    named = cut(nodes.select("node", "root").join(sizes, "root").select("node", "class_id", "class_size"), "named")
    found = signed.select("id", "node").join(named, "node")
    return found.select(
        F.col("id").alias("doc_id"), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of every class, with all its columns.

    Rows whose text is in no class of several are not shuffled, but for false hits of a Bloom filter.
    """
    _, nodes = _node_classes(docs, id_col, text_col)
    # Of a class, the smallest id, nulls last, and the smallest node among equal ids.
    best = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("best")
    several = nodes.groupBy("root").agg(best, F.sum("n").alias("size")).where("size > 1")
    several = cut(several.select("root", "best.first", F.col("best.node").alias("keeper")), "several")
    marks = nodes.select("node", "root").join(several, "root").select(F.col("node").alias("of"), "first", (F.col("node") == F.col("keeper")).alias("stays"))
    marks = cut(marks, "marks")
    filters = cut(repeated_cells(marks.select(F.hex("of").alias("digest")), "digest", least=1), "cells")
    rows = _with_node(docs.select(F.col(id_col).alias("id"), F.struct("*").alias("row")), text_col)
    flagged = maybe_repeated(rows.withColumn("digest", F.hex("node")), "digest", filters, "maybe")
    alone = flagged.where(~F.col("maybe")).select("row.*")
    some = flagged.where("maybe").join(marks, F.col("node") == F.col("of"), "left")
    kept = some.where(F.col("stays").isNull() | (F.col("stays") & F.col("id").eqNullSafe(F.col("first"))))
    return alone.unionByName(kept.dropDuplicates(["node"]).select("row.*"))
