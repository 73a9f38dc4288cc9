"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

A document's tokens and one closing id fill pieces: a text longer than a sequence gives
full pieces after a shorter first one, any other a single piece. Pieces are dealt onto
islands of about ``ISLAND`` pieces. On an island a small population of packings evolves:
a crossover injects the other parent's well-filled bins whole, removes the bins that
hold the same pieces, and puts the displaced pieces back by best fit, largest first;
packings with the fuller bins survive. Then the islands exchange: bins that are full to
``SLACK`` tokens leave as finished sequences, the better half of the others travel to
another island as whole bins (the elite), and the pieces of the rest are dealt anew. Each
epoch has fewer pieces and so fewer islands, until one island is left or hardly any bin fills
up; then all bins are final. Only (piece, length) rows move, never texts or tokens.

Null and empty texts are a single piece of the closing id. Repeated rows and null ids are
packed each by itself. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wayfold.llm.words import KEPT, tidy
from wayfold.storage import cut

LENGTH = 2048
ISLAND = 4000
SLACK = 1
POPULATION = 4
GENERATIONS = 6
#: Bytes of parts and ids that an encoder remembers.
CACHE = 1 << 25
CLOSING = b"\0\0\0\0"

# Fixed value: the splitting pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    A text without two neighbouring white-space characters splits into independent parts before each
    space and each line break. Parts are encoded once and remembered, up to ``CACHE`` bytes of
    them, while tasks of this stage follow each other. Parts of Latin letters go through the faster of two libraries, which has the same
    merges; any other text is left to the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_padding()
        self.slow.no_truncation()
        letters = _byte_letters()
        vocab = self.slow.get_vocab(with_added_tokens=False)
        special = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
        self.fast = tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes | None] = {}
        self.held = 0

    def forget(self) -> None:
        self.known.clear()
        self.held = 0

    def __call__(self, text: str) -> bytes:
        if "<|" not in text:
            parts = ("\n" + text).replace("\n", " \n").split(" ")[1:]  # a part without a line break had a space before it
            try:
                found = b"".join([self.known.get(p) or self._learn(p) for p in parts])
                return found[4:]  # without the line break that was added
            except ValueError:
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, part: str) -> bytes:
        word = part.removeprefix("\n")
        if not word or word[0].isspace() or word[-1].isspace() or max(word) > "ɏ":
            raise ValueError(part)
        ids = self.fast.encode_ordinary(part if part[0] == "\n" else " " + part)
        found = np.array(ids, "<u4").tobytes()
        self.held += 2 * len(part) + len(found) + _ENTRY
        if self.held > CACHE:
            self.forget()
        self.known[part] = found
        return found


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of the vocabulary stands for: printable bytes stand for themselves, the rest follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_ENTRY = 200  # bytes that a remembered part takes beside its characters
_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a text of n ids: full ones, after a shorter first one."""
    first = n % length or length
    starts = [0, *range(first, n, length)]
    return [(s, (t - s)) for s, t in zip(starts, [*starts[1:], n], strict=True)]


def _pieces(batches, path: str, length: int):
    from pyspark import TaskContext

    encode, number = _encoder(path), 0
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
    for batch in batches:
        out, at = [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            ids = encode(text or "") + CLOSING
            for piece, (start, size) in enumerate(cuts(len(ids) // 4, length)):
                out.append(((part << 40) | number, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
                at.append(k)
                number += 1
        columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], names)
    KEPT["packing"] = _ENCODERS.clear  # the next task goes on with the parts; other stages don't need them
    tidy("packing")


class Packing:
    """Bins of piece numbers, with a bin found for any size by best fit."""

    def __init__(self, sizes: list[int], length: int):
        self.sizes, self.length = sizes, length
        self.bins: dict[int, list[int]] = {}
        self.free: dict[int, int] = {}
        self.where = [-1] * len(sizes)
        self.by_free: list[set[int]] = [set() for _ in range(length + 1)]
        self.open = 0  # bit f is set when a bin has f tokens free
        self.next = 0

    def add_bin(self, items: list[int]) -> None:
        name, self.next = self.next, self.next + 1
        self.bins[name] = items
        self._place(name, self.length - sum(self.sizes[i] for i in items))
        for i in items:
            self.where[i] = name

    def remove_bin(self, name: int) -> list[int]:
        self._lift(name)
        for i in self.bins[name]:
            self.where[i] = -1
        return self.bins.pop(name)

    def fit(self, items: list[int]) -> None:
        """Best fit, in the order given."""
        for i in items:
            above = self.open >> self.sizes[i]
            if not above:
                self.add_bin([i])
                continue
            free = self.sizes[i] + (above & -above).bit_length() - 1
            name = next(iter(self.by_free[free]))
            self._lift(name)
            self.bins[name].append(i)
            self.where[i] = name
            self._place(name, free - self.sizes[i])

    def _place(self, name: int, free: int) -> None:
        self.free[name] = free
        self.by_free[free].add(name)
        self.open |= 1 << free

    def _lift(self, name: int) -> None:
        free = self.free.pop(name)
        self.by_free[free].discard(name)
        if not self.by_free[free]:
            self.open &= ~(1 << free)

    def merit(self) -> float:
        """Mean square fill: of two packings, the one with fewer and fuller bins has more."""
        return sum((1 - f / self.length) ** 2 for f in self.free.values()) / max(len(self.free), 1)

    def copy(self) -> Packing:
        other = Packing(self.sizes, self.length)
        for items in self.bins.values():
            other.add_bin(list(items))
        return other


def crossover(one: Packing, other: Packing, chance: random.Random) -> Packing:
    """``one`` with some of the best-filled bins of ``other`` put in whole."""
    child = one.copy()
    ranked = sorted(other.bins, key=lambda b: (other.free[b], b))
    best = ranked[: max(1, len(ranked) // 2)]
    injected = [other.bins[b] for b in best if chance.random() < 0.5]
    held = {i for items in injected for i in items}
    displaced = []
    for name in {child.where[i] for i in held}:
        displaced += [i for i in child.remove_bin(name) if i not in held]
    for items in injected:
        child.add_bin(list(items))
    # The emptiest bins go along, so that their pieces can find better places.
    for name in sorted(child.bins, key=lambda b: (-child.free[b], b))[: 2 + len(child.bins) // 50]:
        displaced += child.remove_bin(name)
    displaced.sort(key=lambda i: (-child.sizes[i], i))
    child.fit(displaced)
    return child


def evolve(sizes: list[int], elite: list[list[int]], length: int, seed: int) -> Packing:
    """The best packing of an island; ``elite`` bins start whole in the first parent."""
    chance = random.Random(seed)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    population = []
    for k in range(POPULATION):
        start = Packing(sizes, length)
        if k == 0:
            for items in elite:
                start.add_bin(list(items))
        # Later parents place pieces in slightly other orders.
        rest = order if k < 2 else sorted(order, key=lambda i: -sizes[i] * (1 + 0.04 * k * (chance.random() - 0.5)))
        start.fit([i for i in rest if start.where[i] < 0])
        population.append(start)
    least = -(-sum(sizes) // length)
    for _ in range(GENERATIONS):
        population.sort(key=lambda p: (len(p.bins), -p.merit()))
        if len(population[0].bins) <= least:
            break
        children = [crossover(population[k % 2], population[1 + k % (POPULATION - 1)] if k % 2 == 0 else population[0], chance) for k in range(POPULATION // 2)]
        population = population[: POPULATION - len(children)] + children
    return min(population, key=lambda p: (len(p.bins), -p.merit()))


def _island(epoch: int, last: bool, length: int):
    """The function that packs one island in this epoch."""

    def packed(key, table):
        return _evolved(key, table, epoch, last, length)

    return packed


def _evolved(key, table: pa.Table, epoch: int, last: bool, length: int) -> pa.Table:
    """Pieces of an island with their bins: finished ones with a sequence, the others to travel on."""
    table = table.sort_by([("row", "ascending")])
    island, sizes = key[0].as_py(), table.column("length").to_pylist()
    groups: dict[int, list[int]] = {}
    for i, name in enumerate(table.column("bin").to_pylist()):
        if name is not None:
            groups.setdefault(name, []).append(i)
    best = evolve(sizes, list(groups.values()), length, 1000 * epoch + island)
    n = len(sizes)
    done, names, offsets = [False] * n, [None] * n, [None] * n
    ranked = sorted(best.bins, key=lambda b: (best.free[b], b))
    finished = {b for b in ranked if last or best.free[b] <= SLACK}
    waiting = [b for b in ranked if b not in finished]
    elite = set(waiting[: len(waiting) // 2])
    for number, b in enumerate(ranked):
        at, name = 0, (epoch << 56) | (island << 24) | number
        for i in best.bins[b]:
            if b in finished:
                done[i], names[i], offsets[i] = True, name, at
                at += sizes[i]
            elif b in elite:
                names[i] = name
    for name, values, kind in (("done", done, pa.bool_()), ("bin", names, pa.int64()), ("offset", offsets, pa.int64())):
        table = table.drop_columns([name]).append_column(name, pa.array(values, kind))
    return table


def pack(pieces: DataFrame, length: int = LENGTH, island: int = ISLAND) -> DataFrame:
    """Add sequence_id and offset to rows with a unique ``row`` and a ``length``."""
    todo = pieces.select("row", "length").withColumns({"bin": F.lit(None).cast("long"), "offset": F.lit(None).cast("long"), "done": F.lit(False)})
    placed, epoch, n, stalled = [], 0, pieces.count(), False
    while True:
        islands = max(1, n // island)
        last = stalled or islands == 1
        # Pieces of one elite bin travel together, any other piece alone.
        dealt = todo.withColumn("island", F.pmod(F.xxhash64(F.lit(epoch), F.coalesce(F.col("bin"), F.lit(-1)), F.when(F.col("bin").isNull(), F.col("row"))), F.lit(islands)))
        packed = cut(dealt.groupBy("island").applyInArrow(_island(epoch, last, length), dealt.schema), "epoch")
        placed.append(packed.where("done").select("row", F.col("bin").alias("sequence_id"), "offset"))
        if last:
            break
        todo = packed.where("NOT done").drop("island")
        left, epoch = todo.count(), epoch + 1
        # Where few bins fill up, another deal would not help: the next epoch's islands finish all they have.
        n, stalled = left, left > 0.75 * n
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return pieces.join(out, "row")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = StructType.fromDDL("row bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    kind = StructType([StructField("doc_id", rows.schema[0].dataType), *found])
    pieces = cut(rows.mapInArrow(lambda batches: _pieces(batches, path, length), kind), "pieces")
    return pack(pieces, length).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
