"""Words of Arrow text columns as 64-bit hashes, computed on the bytes of many rows at once.

A word's hash is the hash of its UTF-8 bytes under a polynomial modulo 2^64 with an
odd base, taken as a difference of prefix sums, and then mixed. Rows are handled in
groups of at most ``SLICE`` bytes, and a longer text in pieces cut at white space, so
memory follows the longest word and never the batch.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C55
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}
#: What a worker keeps from task to task, by owner: how to drop it when a task of another owner ends.
KEPT: dict[str, Callable[[], None]] = {}

#: Bytes that end a word: space and the control characters 9 to 13.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes of words for scoring: ASCII letters and digits, and everything beyond ASCII.
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Byte values with ASCII letters in lower case.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if "up" not in _POWERS or len(_POWERS["up"]) <= n:
        size = max(n, SLICE) + 1
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base & _MASK, np.uint64)
                steps[0] = 1
                _POWERS[key] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finishing steps of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tidy(owner: str = "") -> None:
    """Give memory that a task no longer needs back to the machine: a Python worker outlives its task.

    What ``owner`` keeps for its next task stays, until a task of another owner ends in this worker.
    """
    for name in [n for n in KEPT if n != owner]:
        KEPT.pop(name)()
    for key in [k for k, v in _POWERS.items() if len(v) > SLICE + 1]:  # grown for one very long word
        del _POWERS[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its row offsets; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if len(column) == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _hashes(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, fold: np.ndarray | None):
    """Word hashes of some rows and the number of words of each row."""
    rows = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    mask = keep[data]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = mask[edges]
    last[edges - 1] = mask[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        values = (data if fold is None else fold[data]).astype(np.uint64) + np.uint64(1)
        np.cumsum(values * up[: len(data)], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    counts = np.diff(np.searchsorted(starts, offsets))
    return hashes, counts


def hashed_words(
    column: pa.Array, keep: np.ndarray | None = None, fold: np.ndarray | None = None
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, hashes, words per row) until all rows are covered.

    ``keep`` says which bytes make up words (all but white space by default),
    ``fold`` maps bytes before they are hashed.
    """
    keep = ~BLANK if keep is None else keep
    data, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1
        if end > row:
            part = offsets[row : end + 1]
            hashes, counts = _hashes(data[part[0] : part[-1]], part - part[0], keep, fold)
            yield row, end, hashes, counts
            row = end
            continue
        pieces, at, stop = [], int(offsets[row]), int(offsets[row + 1])
        while at < stop:
            cut = min(at + SLICE, stop)
            while cut < stop:  # never inside a word
                gaps = np.flatnonzero(~keep[data[at:cut]])
                if len(gaps):
                    cut = at + int(gaps[-1]) + 1
                    break
                cut = min(cut + SLICE, stop)
            piece = data[at:cut]
            pieces.append(_hashes(piece, np.array([0, len(piece)]), keep, fold)[0])
            at = cut
        hashes = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        yield row, row + 1, hashes, np.array([len(hashes)])
        row += 1


def runs(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words within a row, and their number per row.

    A row with fewer words, but at least one, gives one run of all its words.
    """
    n = np.maximum(counts - width + 1, np.minimum(counts, 1))
    if len(hashes) == 0:
        return hashes, n
    starts = np.repeat(np.cumsum(counts) - counts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    left = np.repeat(counts, n) - (starts - np.repeat(np.cumsum(counts) - counts, n))
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            word = np.where(left > k, hashes[np.minimum(starts + k, len(hashes) - 1)], np.uint64(k + 1))
            out = mixed((out ^ word) + np.uint64(0x9E3779B97F4A7C15))
    return out, n
