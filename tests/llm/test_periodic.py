"""Periodic runs against their definition, and the transform against plain sums."""

import hashlib
import zlib

import numpy as np
import pytest

from wayfold.llm import periodic


def by_definition(words):
    """Every maximal stretch per period, kept where no smaller period fits."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        same = list(words[:-q] == words[q:]) + [False]
        start = None
        for i, equal in enumerate(same):
            if equal and start is None:
                start = i
            if not equal and start is not None:
                length = i - start + q
                part = words[start : start + length]
                if length >= max(24, 3 * q) and all((part[:-d] != part[d:]).any() for d in range(1, q)):
                    out.append((start, length, q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts_with_runs(seed, count):
    rng, out = np.random.default_rng(seed), []
    for _ in range(count):
        n, kinds = int(rng.integers(0, 600)), int(rng.integers(1, 6)) + (60 if rng.random() < 0.5 else 0)
        words = rng.integers(0, kinds, n)
        for _ in range(int(rng.integers(0, 4))):
            if n > 30:
                period, start = int(rng.integers(1, n // 3)), int(rng.integers(0, n))
                end = min(n, start + period * int(rng.integers(2, 6)) + int(rng.integers(0, period + 1)))
                words[start:end] = np.resize(words[start : start + period].copy(), end - start)
        out.append(words)
    return out


@pytest.mark.parametrize("size", [16, 64, 128, 256, 2048])
def test_transform_is_exact(size):
    rng = np.random.default_rng(size)
    a, b = (rng.integers(0, periodic.PRIME, (3, size)) for _ in range(2))
    back = periodic.restored(periodic.transform(a.astype(float)))
    assert ((back - a) % periodic.PRIME == 0).all()
    product = periodic._reduced(periodic.transform(a.astype(float)) * periodic.transform(b.astype(float)))
    cyclic = [sum(int(a[0, i]) * int(b[0, (k - i) % size]) for i in range(size)) % periodic.PRIME for k in range(size)]
    assert (periodic.restored(product)[0] % periodic.PRIME == cyclic).all()


@pytest.mark.parametrize("seed", range(8))
def test_runs_by_definition(seed):
    texts = texts_with_runs(seed, 25)
    assert periodic.runs_of(texts) == [by_definition(t) for t in texts]


@pytest.mark.parametrize("widest", [8, 16, 32])
def test_windows_in_pieces(monkeypatch, widest):
    """The way of very long texts, forced on short ones."""
    monkeypatch.setattr(periodic, "WIDEST", widest)
    texts = texts_with_runs(50 + widest, 25)
    assert periodic.runs_of(texts) == [by_definition(t) for t in texts]


def test_long_texts():
    unit = np.random.default_rng(3).integers(0, 5000, 70_000)
    assert periodic.runs_of([np.resize(unit, 220_000)]) == [[(0, 220_000, 70_000)]]
    assert periodic.runs_of([np.zeros(200_000, np.int64)]) == [[(0, 200_000, 1)]]
    assert periodic.runs_of([np.arange(100_000)]) == [[]]


def expected(doc_id, text):
    words = (text or "").split(" ") if text else []
    words = [w for w in words if w]
    name = "" if doc_id is None else str(doc_id)
    h, n = zlib.crc32(name.encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    numbers = {w: k for k, w in enumerate(words)}
    runs = by_definition(np.array([numbers[w] for w in words], np.int64))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-(r[1] / r[2]), r[0], r[2])) if runs else (None, None, None)
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_documents(spark, rows):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 200, int(rng.integers(0, 300)))) for _ in range(120)]
    data = [(i, t) for i, t in enumerate(texts)]
    data += [(1000, None), (1001, ""), (None, "a b " * 40), (None, "a b " * 40), (7, "x " * 100), (1002, " ".join(["one", "two"] * 30_000))]
    docs = spark.createDataFrame([(i, t, "n") for i, t in data], "doc_id long, text string, n_runs string").repartition(3)
    got = rows(periodic.periodic_runs(docs, change=periodic.planted))
    known = {repr(r) for r in got}
    missing = [i for i, t in data if i != 1002 and repr(expected(i, t)) not in known]
    assert not missing and len(got) == len(data)
    long = next(r for r in got if r[0] == 1002)
    assert long[2:6] == (0, 60_000, 2, 30_000_000) if zlib.crc32(b"1002") % 10 else long[1] >= 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(docs).count() == 0


def test_spaces_of_other_kinds_are_no_gaps(spark):
    docs = spark.createDataFrame([(1, "a b\tc\x0bd\x1ce\r\nf")], "doc_id long, text string")
    row = periodic.periodic_runs(docs).first()
    assert row["collapsed_sha256"] == hashlib.sha256("a b c d\x1ce f".encode()).hexdigest()
