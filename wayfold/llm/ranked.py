"""Ranked lexical search: hashed max-sketches give upper bounds, exact scores follow until the threshold.

Index: one pass over the texts folds every document into a sketch. A term falls into one of
``CELLS`` cells by its hash, a cell keeps the greatest count of a term in it, and only filled
cells are stored. The weight of a count within a document grows with it, so the sketch's
weight of a cell is at least that of every term in it. The same pass counts, for terms of the query set
only, how many documents hold them.

Search, for blocks of at most ``BLOCK`` queries: a query's terms add their weights to its cells, and the
product of sketch weights and query weights is an upper bound of every score. The ``FIRST`` best
bounds of each query are scored exactly on the texts, which gives each query a threshold: the
score and id that its list of k ends with. Documents whose bound does not reach it cannot enter. All others are scored
in descending order of bound, ``WAVE`` times more in each wave, and every wave raises the thresholds,
until no bound is left that reaches one. So the result is exact whatever the sketches collide in.

Sizes: bounds are matrix products of at most ``ROWS`` documents with a block of queries; a task sends its
``FIRST`` best pairs of a query, or the pairs above the threshold. The query terms in a broadcast are those of one block. Pairs and not
texts are shuffled, and texts that are no candidate are not read into words.

Null and empty texts have no term, are in no list and do not count; the same holds for queries. Queries that share an id are one. A
null id sorts last and is written as null. Rows that share an id are ranked each by itself. Extra
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.llm.exact import maybe_repeated, repeated_cells
from wayfold.storage import cut

TOP = 10
CELLS = 1 << 16
BLOCK = 256
FIRST = 32
WAVE = 8
ROWS = 512
_PIECE = 1 << 20
_HELD = 1 << 17
_NO_ID = -(1 << 63)
# In UTF-8 the bytes of everything beyond ASCII are 0x80 and above.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def terms(text: bytes) -> Counter:
    """How often each term occurs; A to Z count as lower case. A long text is read in pieces cut at a gap."""
    if len(text) <= _PIECE:
        return Counter(_TERM.findall(text.lower()))
    found, at = Counter(), 0
    while at < len(text):
        gap = _GAP.search(text, at + _PIECE)
        end = gap.start() if gap else len(text)
        found.update(_TERM.findall(text[at:end].lower()))
        at = end
    return found


def cell(term: bytes) -> int:
    return zlib.crc32(term) & (CELLS - 1)


@dataclass(frozen=True)
class Totals:
    """Documents with a term, and terms of all documents."""

    documents: int
    terms: int

    def weight(self, holding: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * holding + 1)))

    def measure(self, n):
        """The length factor of a document of n terms."""
        return 100 - 75 + (75 * n * self.documents) // self.terms


# --- index ---------------------------------------------------------------------


def _index_batches(wanted: np.ndarray):
    """Rows of (kind, place, n, cells, counts, term, holding): kind 0 a document, kind 1 a partial count of holders."""
    schema = pa.schema(
        [("kind", pa.int32()), ("place", pa.int64()), ("n", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary()),
         ("term", pa.binary()), ("holding", pa.int64())]
    )

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding: Counter = Counter()
        for batch in batches:
            rows = []
            for place, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms(text.as_py()) if text.is_valid else Counter()
                if not found:
                    continue
                hashes = np.fromiter(map(zlib.crc32, found), np.int64, len(found)) & (CELLS - 1)
                counts = np.minimum(np.fromiter(found.values(), np.int64, len(found)), 255).astype(np.uint8)
                order = np.lexsort((counts, hashes))
                hashes, counts = hashes[order], counts[order]
                last = np.append(hashes[1:] != hashes[:-1], True)  # the greatest count of a cell
                mine = np.flatnonzero(wanted[hashes[last]])
                if len(mine):
                    known = wanted[np.fromiter(map(zlib.crc32, found), np.int64, len(found)) & (CELLS - 1)]
                    holding.update(t for t, k in zip(found, known.tolist(), strict=True) if k)
                rows.append((0, place, sum(found.values()), hashes[last].astype("<u2").tobytes(), counts[last].tobytes(), None, None))
                if len(rows) >= 1024:
                    yield out(rows)
                    rows = []
            if len(holding) > _HELD:
                rows += [(1, None, None, None, None, t, k) for t, k in holding.items()]
                holding.clear()
            if rows:
                yield out(rows)
        if holding:
            yield out([(1, None, None, None, None, t, k) for t, k in holding.items()])

    return indexed


def _query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term, times), one row per query and term."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms(text.as_py()) if text.is_valid else Counter()
                yield pa.record_batch(
                    [pa.array([item] * len(found), pa.int64()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                    names=["item", "term", "times"],
                )

    rows = queries.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    return cut(rows.mapInArrow(split, "item long, term binary, times long"), "queryterms")


def _wanted(asked: DataFrame) -> np.ndarray:
    """Which of the CELLS cells some query looks up."""
    cells = asked.select((F.crc32("term").bitwiseAND(CELLS - 1)).alias("cell")).distinct().collect()  # CELLS rows at most
    out = np.zeros(CELLS, bool)
    out[[r["cell"] for r in cells]] = True
    return out


# --- bounds --------------------------------------------------------------------


@dataclass(frozen=True)
class Block:
    """The queries of a block: per query its terms with summed weights, and per looked-up cell its column."""

    items: list[int | None]
    weights: list[dict[bytes, int]]
    column: np.ndarray  # of each cell, -1 where no query looks
    matrix: np.ndarray  # columns x queries

    @staticmethod
    def of(rows: Sequence, totals: Totals) -> Block:
        found: dict[int | None, dict[bytes, int]] = {}
        for r in rows:
            found.setdefault(r["item"], {})[bytes(r["term"])] = r["times"] * totals.weight(r["holding"])
        cells = sorted({cell(t) for w in found.values() for t in w})
        column = np.full(CELLS, -1, np.int64)
        column[cells] = np.arange(len(cells))
        matrix = np.zeros((len(cells), len(found)))
        for q, w in enumerate(found.values()):
            for t, weight in w.items():
                matrix[column[cell(t)], q] += weight
        return Block(list(found), list(found.values()), column, matrix)

    def bounds(self, sketches: Sequence[tuple[int, bytes, bytes]], totals: Totals) -> np.ndarray:
        """Upper bounds of documents given as (n, cells, counts), one row a document; whole numbers, so exact sums."""
        weight = np.zeros((len(sketches), len(self.matrix)))
        for k, (n, cells, counts) in enumerate(sketches):
            column = self.column[np.frombuffer(cells, "<u2")]
            mine = column >= 0
            tf = np.frombuffer(counts, np.uint8)[mine].astype(np.int64)
            # A count of 255 stands for any greater one, whose weight stays below a million.
            weight[k, column[mine]] = np.where(tf == 255, 10**6, 10**9 * tf // (1000 * tf + 8 * totals.measure(n)))
        return weight @ self.matrix

    def scores(self, text: bytes, chosen: Sequence[int], totals: Totals) -> list[int]:
        """Exact scores of a text for some queries of the block."""
        found = terms(text)
        m = totals.measure(sum(found.values()))
        return [
            sum(w * (10**9 * found[t] // (1000 * found[t] + 8 * m)) for t, w in self.weights[q].items() if t in found)
            for q in chosen
        ]


_PAIRS = "place long, q int, bound long"
_PAIR_SCHEMA = pa.schema([("place", pa.int64()), ("q", pa.int32()), ("bound", pa.int64())])


def _bounded(sent, totals: Totals, first: int | None, floors: tuple[np.ndarray, np.ndarray] | None):
    """Pairs of a part of the index: the ``first`` best of each query, or all whose bound reaches its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = sent.value
        width = len(block.items)
        best: list[list[np.ndarray]] = []

        def trimmed(parts: list) -> list:
            place, q, bound = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((place, -bound, q))
            place, q, bound = place[order], q[order], bound[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            return [[x[rank < first] for x in (place, q, bound)]]

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for at in range(0, batch.num_rows, ROWS):
                place, *sketch = (c[at : at + ROWS] for c in columns)
                bounds = block.bounds(list(zip(*sketch, strict=True)), totals).astype(np.int64)
                if floors is not None:
                    least, before = floors
                    ids = np.array(place)
                    ids[ids == _NO_ID] = np.iinfo(np.int64).max  # they sort last
                    row, q = np.nonzero((bounds > least) | ((bounds == least) & (ids[:, None] < before)))
                    if len(row):
                        yield pa.record_batch([pa.array(np.array(place)[row]), pa.array(q.astype(np.int32)), pa.array(bounds[row, q])], schema=_PAIR_SCHEMA)
                    continue
                some = min(first, len(bounds))
                row = np.argpartition(-bounds, some - 1, axis=0)[:some].ravel()
                q = np.tile(np.arange(width), some)
                known = bounds[row, q] > 0
                best.append([np.array(place)[row[known]], q[known], bounds[row, q][known]])
                if sum(len(b[0]) for b in best) > 4 * first * width:
                    best = trimmed(best)
        if best:
            place, q, bound = trimmed(best)[0]
            yield pa.record_batch([pa.array(place), pa.array(q.astype(np.int32)), pa.array(bound)], schema=_PAIR_SCHEMA)

    return run


# --- search --------------------------------------------------------------------


def _scored(spark: SparkSession, texts: DataFrame, pairs: DataFrame, sent, totals: Totals) -> DataFrame:
    """(q, place, doc_id, score) of pairs (place, q): each chosen text is read once for all its queries."""
    by_text = cut(pairs.groupBy("place").agg(F.collect_set("q").alias("qs")), "chosen")  # a block's queries at most
    # A Bloom filter of fixed size leaves the texts of candidates, and few others, to the join.
    digest = F.sha2(F.col("place").cast("string"), 256)
    filters = cut(repeated_cells(by_text.select(digest.alias("digest")), "digest", least=1), "cells")
    texts = maybe_repeated(texts.withColumn("digest", digest), "digest", filters, "maybe").where("maybe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = sent.value
        for batch in batches:
            out = []
            for place, doc_id, text, qs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(q, place, doc_id, s) for q, s in zip(qs, block.scores(text or b"", qs, totals), strict=True) if s > 0]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["q", "place", "doc_id", "score"])

    joined = texts.join(by_text, "place").select("place", "doc_id", "text", "qs")
    return cut(joined.mapInArrow(run, "q int, place long, doc_id long, score long"), "scored")


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query in the order of the result."""
    order = W.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "place")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows by their id, which unlike a row's place stays the same whatever tasks read them; rows that share one are scored together."""
    own = F.col(id_col).cast("long")
    return docs.select(F.coalesce(own, F.lit(_NO_ID)).alias("place"), own.alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def search(
    docs: DataFrame,
    queries: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    query_col: str = "text",
    k: int = TOP,
    first: int = FIRST,
    block_size: int = BLOCK,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query, with a score above 0.

    ``docs`` is a table as stored: it is read again for the texts of candidates.
    """
    spark = docs.sparkSession
    asked = _query_terms(queries, item_col, query_col)
    texts = _numbered(docs, id_col, text_col)
    index = cut(
        texts.select("place", "text").mapInArrow(
            _index_batches(_wanted(asked)), "kind int, place long, n long, cells binary, counts binary, term binary, holding long"
        ),
        "sketches",
    )
    sketches = index.where("kind = 0").select("place", "n", "cells", "counts")
    told = sketches.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not told["documents"]:
        return empty
    totals = Totals(told["documents"], told["terms"])
    holding = index.where("kind = 1").groupBy("term").agg(F.sum("holding").alias("holding"))
    # Queries are numbered by id, so that a block is a range of numbers.
    known = asked.join(holding, "term")
    number = F.dense_rank().over(W.orderBy(F.col("item").asc_nulls_last())) - 1
    items = known.select("item").distinct().select("item", number.alias("number"))
    known = cut(known.join(items, known["item"].eqNullSafe(items["item"])).drop(items["item"]), "asked")
    last = known.agg(F.max("number")).first()[0]
    found = []
    for low in range(0, (-1 if last is None else last) + 1, block_size):
        block = Block.of(known.where(F.col("number").between(low, low + block_size - 1)).orderBy("number", "term").collect(), totals)
        found.append(_search_block(spark, texts, sketches, block, totals, k, first))
    return functools.reduce(DataFrame.unionByName, found, empty)


def _search_block(
    spark: SparkSession, texts: DataFrame, sketches: DataFrame, block: Block, totals: Totals, k: int, first: int
) -> DataFrame:
    """The k best documents of each query of a block."""
    sent = spark.sparkContext.broadcast(block)
    width = len(block.items)
    best = sketches.mapInArrow(_bounded(sent, totals, first, None), _PAIRS)
    order = W.partitionBy("q").orderBy(F.desc("bound"), "place")
    start = cut(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first).drop("rank"), "first")
    done = _scored(spark, texts, start.select("place", "q"), sent, totals)
    floors = _floors(done, k, width)
    # All other pairs that may enter, each with its rank by bound.
    rest = cut(sketches.mapInArrow(_bounded(sent, totals, None, floors), _PAIRS), "reaching")
    rest = cut(
        rest.join(start.select("place", "q"), ["place", "q"], "left_anti").withColumn("rank", F.row_number().over(order)), "ranked"
    )
    at, size, longest = 0, first * WAVE, rest.agg(F.max("rank")).first()[0] or 0
    while at < longest:
        limits = spark.createDataFrame([(q, int(s), int(i)) for q, (s, i) in enumerate(zip(*floors, strict=True))], "q int, floor long, before long")
        wave = rest.where((F.col("rank") > at) & (F.col("rank") <= at + size)).join(limits, "q")
        wave = wave.where("bound > floor OR bound = floor AND place < before")
        # The k best of what is known stand for all that is known.
        done = cut(_best(done.unionByName(_scored(spark, texts, wave.select("place", "q"), sent, totals)), k).drop("rank"), "best")
        floors = _floors(done, k, width)
        at, size = at + size, size * WAVE
    names = spark.createDataFrame(list(enumerate(block.items)), "q int, item_id long")
    return _best(done, k).join(names, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _floors(scored: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What a document has to beat to enter each query's list: score and id of the k-th, or 0 in a shorter list."""
    least, before = np.zeros(width, np.int64), np.full(width, _NO_ID)
    for r in _best(scored, k).where(F.col("rank") == k).select("q", "score", "doc_id").collect():  # a row a query
        least[r["q"]] = r["score"]
        before[r["q"]] = np.iinfo(np.int64).max if r["doc_id"] is None else r["doc_id"]
    return least, before
