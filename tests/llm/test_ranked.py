"""Ranked search against scoring every document for every query."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from wayfold.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def by_definition(docs, queries, k=10):
    split = lambda t: Counter(TERM.findall((t or "").translate(LOWER)))
    counts = [(i, split(t)) for i, t in docs]
    total, all_terms = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in queries:
        weights = {t: n * math.floor(1000 * math.log((2 * total + 2) / (2 * holding[t] + 1))) for t, n in split(text).items()}
        scores = []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * total // all_terms if all_terms else 0
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weights.items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(scores[:k], start=1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"Word{k}" if k % 3 else f"ñá{k}" for k in range(400)]
    frequent = [1 / (k + 1) for k in range(400)]
    text = lambda size: " ".join(rng.choices(vocabulary, frequent, k=size))
    docs = [(i, text(rng.randint(0, 80))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(40)]  # a group of copies
    docs += [(None, docs[7][1]), (None, None), (3, docs[3][1]), (9001, None), (9002, ""), (9003, "--- ..."), (9004, "word1 " * 400)]
    queries = [(k, text(rng.randint(1, 30))) for k in range(12)]
    queries += [(12, docs[5][1]), (13, ""), (14, None), (15, "absent words only"), (16, docs[7][1]), (17, "word1"), (None, "WORD2 word2")]
    return docs, queries


@pytest.mark.parametrize(("seed", "first", "block"), [(1, 32, 256), (2, 2, 5), (3, 1, 100)])
def test_equals_scoring_all(spark, rows, seed, first, block):
    docs, queries = corpus(seed, 300)
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, score int").repartition(4)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    found = ranked.search(frame, asked, first=first, block_size=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(found) == by_definition(docs, queries)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.search(docs, some).count() == 0
    texts = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ranked.search(texts, some.limit(0)).count() == 0
    assert [tuple(r) for r in ranked.search(texts, some).collect()] == by_definition([(1, "a b")], [(1, "a b")])


@pytest.mark.parametrize("cells", [8, 1 << 16])
def test_bounds_are_never_below_scores(monkeypatch, cells):
    """With eight cells nearly all terms collide."""
    monkeypatch.setattr(ranked, "CELLS", cells)
    docs, queries = corpus(5, 100)
    totals = ranked.Totals(100, 4000)
    rows = [{"item": q, "term": t, "times": n, "holding": 3} for q, text in queries for t, n in ranked.terms((text or "").encode()).items()]
    block = ranked.Block.of(rows, totals)
    for _, text in docs:
        found = ranked.terms((text or "").encode())
        greatest: dict[int, int] = {}
        for t, n in found.items():
            greatest[ranked.cell(t)] = max(greatest.get(ranked.cell(t), 0), min(n, 255))
        sketch = (sum(found.values()), np.array(list(greatest), "<u2").tobytes(), np.array(list(greatest.values()), np.uint8).tobytes())
        bounds = block.bounds([sketch], totals)[0]
        scores = block.scores((text or "").encode(), range(len(block.items)), totals)
        assert (bounds >= scores).all()


def test_long_texts_in_pieces(monkeypatch):
    text = ("Alpha beta-gamma ñandú " * 50).encode()
    whole = ranked.terms(text)
    monkeypatch.setattr(ranked, "_PIECE", 7)
    assert ranked.terms(text) == whole
