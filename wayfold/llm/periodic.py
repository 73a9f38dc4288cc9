"""Periodic runs of words, found by block convolution with an exact number-theoretic transform.

A run is a stretch of words with smallest period q and at least max(LEAST, 3 q) words that no
neighbour extends. At every dyadic scale B a text is cut into blocks of B words. A run whose period
lies in [B, 2 B) holds a whole block together with its copy one period later, so it is enough
to find, for each block, the distances d in that window at which the block occurs again: there
the sum of squared differences is zero. That sum is two sums of squares less twice a
correlation, and all correlations of a scale come from transforms modulo the Fermat prime
65537 over the blocks of many texts at once. Words are random residues there, so equal blocks
always give zero and others by chance only, and every distance found is verified on the words
themselves while it is extended to both sides. The lowest scale, 8, also covers the periods below 8.
A pattern has at most ``WIDEST`` words; at higher scales the first ones of a block stand for it
and its window is read in pieces.

The transform is a matrix product (two, with twiddle factors between them, beyond 128
places) of whole numbers below 2^53 in doubles, so it is exact in every step.

One row per document. Null and empty texts have no words and no run. Repeated rows are handled
each by itself, and a null id is written as an empty text when the id is hashed. Extra columns are not read,
so their names do not matter; an empty table gives an empty result. A text is handled
whole by one task, its blocks in slices of ``SLICE`` words.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 24
EXPONENT = 3
LOWEST = 8
WIDEST = 1 << 15
SLICE = 1 << 17
PRIME = 65537
_GENERATOR = 3  # a primitive root of PRIME
_MOST_DIRECT = 128

Run = tuple[int, int, int]  # start, length, period


# --- the transform -------------------------------------------------------------


def _reduced(x: np.ndarray) -> np.ndarray:
    """The same residues between -PRIME and 2 PRIME."""
    x -= np.floor(x * (1.0 / PRIME)) * PRIME
    return x


@functools.cache
def _powers(size: int, inverse: bool) -> np.ndarray:
    """The powers of a root of unity of order ``size``."""
    root = pow(_GENERATOR, (PRIME - 1) // size, PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    out = np.ones(size, np.int64)
    for k in range(1, size):
        out[k] = out[k - 1] * root % PRIME
    return out


@functools.cache
def _matrix(size: int, inverse: bool) -> np.ndarray:
    places = np.arange(size)
    return _powers(size, inverse)[np.outer(places, places) % size].astype(float)


@functools.cache
def _twiddles(size: int, high: int, inverse: bool) -> np.ndarray:
    return _powers(size, inverse)[np.outer(np.arange(high), np.arange(size // high))].astype(float)


def _split(size: int) -> int:
    return 1 << ((size.bit_length() - 1) // 2)


def transform(x: np.ndarray) -> np.ndarray:
    """The transform of every row; beyond 128 places in an order that only :func:`restored` knows."""
    size = x.shape[1]
    if size <= _MOST_DIRECT:
        return _reduced(x @ _matrix(size, False))
    high = _split(size)
    y = _reduced(_matrix(high, False) @ x.reshape(-1, high, size // high))
    y *= _twiddles(size, high, False)
    return _reduced(_reduced(y) @ _matrix(size // high, False)).reshape(-1, size)


def restored(x: np.ndarray) -> np.ndarray:
    """The inverse of :func:`transform`."""
    size = x.shape[1]
    share = float(pow(size, -1, PRIME))
    if size <= _MOST_DIRECT:
        return _reduced(_reduced(x @ _matrix(size, True)) * share)
    high = _split(size)
    y = _reduced(x.reshape(-1, high, size // high) @ _matrix(size // high, True))
    y *= _twiddles(size, high, True)
    y = _reduced(_matrix(high, True) @ _reduced(y))
    return _reduced(y * share).reshape(-1, size)


# --- occurrences of blocks -------------------------------------------------------


def _zeros(values: np.ndarray, squares: np.ndarray, starts: np.ndarray, far: np.ndarray, width: int, shifts: int) -> np.ndarray:
    """For patterns of ``width`` words from ``starts``: at which of ``shifts`` places from ``far`` on the sum vanishes.

    ``values`` are residues, ``squares`` the running sums of their squares; reading beyond the end repeats the last word.
    """
    size = 1 << (width + shifts - 2).bit_length()
    last = len(values) - 1
    pattern = np.zeros((len(starts), size))
    pattern[:, :width] = values[starts[:, None] + np.arange(width - 1, -1, -1)]
    window = values[np.minimum(far[:, None] + np.arange(size), last)]
    product = _reduced(transform(pattern) * transform(window))
    cross = restored(product)[:, width - 1 : width - 1 + shifts]
    own = squares[starts + width] - squares[starts]
    at = np.minimum(far[:, None] + np.arange(shifts), last)
    there = squares[np.minimum(at + width, last + 1)] - squares[at]
    total = own[:, None] + there - 2 * cross
    return np.rint(total / PRIME) * PRIME == total


def seeds(texts: Sequence[np.ndarray], block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per text with any: its number, block starts and distances where a block of this scale may occur again.

    ``texts`` are arrays of word numbers. At the lowest scale distances begin at 1, else at ``block``.
    """
    first = 1 if block == LOWEST else block
    width = min(block, WIDEST)
    sizes = np.array([len(t) for t in texts])
    offsets = np.cumsum(sizes) - sizes
    blocks = np.maximum((sizes - first) // block, 0)
    if not blocks.any():
        return
    words = np.concatenate(texts)
    values = ((words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % PRIME
    squares = np.zeros(len(values) + 1)
    np.cumsum(values * values % PRIME, out=squares[1:])
    values = values.astype(float)
    owner = np.repeat(np.arange(len(texts)), blocks)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * block
    step = max(1, SLICE // (2 * width))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for low in range(first, 2 * block, width if block > LOWEST else 2 * block):
        shifts = min(width, 2 * block - low) if block > LOWEST else 2 * block - 1
        for at in range(0, len(owner), step):
            mine, from_ = owner[at : at + step], start[at : at + step]
            place = from_ + offsets[mine]
            hit = _zeros(values, squares, place, place + low, width, shifts)
            row, shift = np.nonzero(hit)
            inside = from_[row] + low + shift + block <= sizes[mine[row]]
            row, shift = row[inside], shift[inside]
            found.append((mine[row], from_[row], low + shift))
    text, place, distance = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((place, distance, text))
    text, place, distance = text[order], place[order], distance[order]
    for t in np.unique(text):
        a, b = np.searchsorted(text, (t, t + 1))
        yield int(t), place[a:b], distance[a:b]


# --- runs from seeds -------------------------------------------------------------


def _reach(words: np.ndarray, at: int, distance: int, step: int) -> int:
    """How many words from ``at`` on, going by ``step``, equal those ``distance`` later."""
    count, size = 0, 64
    while True:
        if step > 0:
            a, b = at + count, min(at + count + size, len(words) - distance)
            same = words[a:b] == words[a + distance : b + distance]
        else:
            a, b = max(at - count - size + 1, 0), at - count + 1
            same = (words[a:b] == words[a + distance : b + distance])[::-1]
        if b <= a:
            return count
        wrong = np.flatnonzero(~same)
        if len(wrong):
            return count + int(wrong[0])
        count += len(same)
        size *= 2


def extend(words: np.ndarray, block: int, starts: np.ndarray, distances: np.ndarray, runs: list[Run]) -> None:
    """Verify and extend seeds (sorted by distance), adding the new runs to ``runs``.

    A seed inside a known stretch is dropped where the distance is a multiple of that stretch's period:
    the stretch is what it would be extended to.
    """
    for start, length, period in runs:
        left = (starts < start) | (starts + block + distances > start + length) | (distances % period != 0)
        starts, distances = starts[left], distances[left]
    while len(starts):
        at, distance = int(starts[0]), int(distances[0])
        after = _reach(words, at, distance, 1)
        if after < block:  # equal residues of different words
            starts, distances = starts[1:], distances[1:]
            continue
        start = at - _reach(words, at - 1, distance, -1)
        length = at + after + distance - start
        if length >= max(LEAST, EXPONENT * distance):
            runs.append((start, length, distance))
        left = (starts < start) | (starts + block + distances > start + length)
        left |= distances % distance != 0 if length >= max(LEAST, EXPONENT * distance) else distances != distance
        starts, distances = starts[left], distances[left]


def runs_of(texts: Sequence[np.ndarray]) -> list[list[Run]]:
    """All runs of each text (arrays of word numbers), by start and period."""
    out: list[list[Run]] = [[] for _ in texts]
    block, longest = LOWEST, max(map(len, texts), default=0)
    while max(LEAST, EXPONENT * (1 if block == LOWEST else block)) <= longest:
        least = max(LEAST, EXPONENT * block)
        chosen = [i for i, t in enumerate(texts) if len(t) >= least]
        for i, starts, distances in seeds([texts[i] for i in chosen], block):
            extend(texts[chosen[i]], block, starts, distances, out[chosen[i]])
        block *= 2
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


# --- documents -------------------------------------------------------------------


def planted(doc_id: str, words: list[bytes]) -> list[bytes]:
    """The words of a document with the periodic tail that a tenth of the ids get."""
    h, n = zlib.crc32(doc_id.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal ones alike."""
    last = dict(zip(words, range(len(words)), strict=True))
    return np.fromiter(map(last.__getitem__, words), np.int64, len(words))


def dropped(n: int, runs: Sequence[Run]) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) > 0


_SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _row(words: list[bytes], runs: list[Run]) -> tuple:
    """The columns after the id."""
    listed = _digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode())
    gone = dropped(len(words), runs)
    kept = _digest(b" ".join(w for w, out in zip(words, gone.tolist(), strict=True) if not out) if runs else b" ".join(words))
    best = None
    for run in runs:  # by start, then period, so the first of equals stays
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    start, length, period = best or (None, None, None)
    return len(runs), start, length, period, None if best is None else 1000 * length // period, listed, kept


def _batches(change: Callable[[str, list[bytes]], list[bytes]] | None):
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
        + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
    )

    def groups(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
        """Rows of about SLICE words at a time."""
        held, size = [], 0
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            words = text.as_py().split() if text.is_valid else []
            name = doc_id.as_py()
            words = change("" if name is None else str(name), words) if change else words
            held.append((name, words))
            size += len(words)
            if size >= SLICE:
                yield held
                held, size = [], 0
        if held:
            yield held

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in groups(batch):
                runs = runs_of([numbered(words) for _, words in held])
                rows = [(name, *_row(words, r)) for (name, words), r in zip(held, runs, strict=True)]
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return found


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    change: Callable[[str, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Per document: number of runs, the run of greatest exponent, digests of all runs and of the text without repeats.

    ``change`` may alter the words (given the id as text) before runs are searched. Equal exponents go to the
    smaller start, then the smaller period.
    """
    # Words end at the bytes 9 to 13 and 32, which is how bytes are split without an argument.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_batches(change), _SCHEMA)
