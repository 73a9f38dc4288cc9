"""Exact and near duplicates against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold.llm import exact, neardup
from wayfold.llm.words import hashed_words, runs


def bag(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def near_classes(rows):
    """Smallest id per class of all-pairs links, by union and find."""
    bags, root = [bag(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sum(bags[i].values()), sum(bags[j].values())
            if a == b == 0 or (min(a, b) >= 0.8 * max(a, b) and (c := sum((bags[i] & bags[j]).values())) >= 0.8 * (a + b - c) and c):
                root[find(i)] = find(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    return [(i, min((x for x in ids[find(k)] if x is not None), default=None), len(ids[find(k)])) for k, (i, _) in enumerate(rows)]


def test_words_and_runs():
    texts = ["a b  c", "", None, "\t é\n", "a b c d e f", "a b c d e g"]
    (first, end, hashes, counts), = hashed_words(pa.array(texts))
    assert (first, end, counts.tolist()) == (0, 6, [3, 0, 0, 1, 6, 6])
    assert hashes[0] == hashes[4] and hashes[9] != hashes[15]
    shingles, n = runs(hashes, counts, 5)
    assert n.tolist() == [1, 0, 0, 1, 2, 2] and shingles[2] == shingles[4] and shingles[3] != shingles[5]


def test_long_text_is_hashed_in_pieces(monkeypatch):
    import wayfold.llm.words as words

    text = " ".join(f"w{k}" for k in range(3000)) + " " + "y" * 5000
    whole = next(hashed_words(pa.array([text])))[2]
    monkeypatch.setattr(words, "SLICE", 1000)
    assert (next(hashed_words(pa.array([text])))[2] == whole).all()


def test_mark_copies(odd, none):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.mark_copies(odd).collect()), key=repr)
    same, empty = [(1, 1, 3, True), (2, 1, 3, False), (2, 1, 3, False)], [(3, 3, 2, True), (4, 3, 2, False)]
    alone = [(i, i, 1, True) for i in (5, 7, 8, 9, None)]
    assert got == sorted(same + empty + alone, key=repr)
    assert exact.mark_copies(none).count() == 0


@pytest.mark.parametrize("bits", [1 << 25, 1 << 15])
def test_drop_copies(odd, none, bits):
    out = exact.drop_copies(odd, bits=bits)
    assert out.columns == odd.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([1, 3, 5, 7, 8, 9, None], key=repr)
    assert exact.drop_copies(none).count() == 0


def test_a_full_filter_changes_nothing(documents):
    full = exact.mark_copies(documents, bits=64).orderBy("doc_id").collect()
    assert full == exact.mark_copies(documents).orderBy("doc_id").collect()


def test_signatures_estimate_weighted_similarity():
    chance, base = random.Random(3), [f"w{k % 211}" for k in range(900)]
    other = [w if chance.random() > 0.03 else f"z{k}" for k, w in enumerate(base)]
    column = pa.array([" ".join(base), " ".join(other), "a b c d e f g " * 50, "a b c d e f g " * 40])
    (_, _, hashes, counts), = hashed_words(column)
    table = neardup.signatures(*neardup.bags(hashes, counts), 4)
    true = neardup.similarity(column.take(pa.array([0, 2])), column.take(pa.array([1, 3])))
    found = [(table[0] == table[1]).mean(), (table[2] == table[3]).mean()]
    assert np.abs(np.array(found) - true).max() < 0.1
    assert true[1] == sum((bag(column[2].as_py()) & bag(column[3].as_py())).values()) / sum((bag(column[2].as_py()) | bag(column[3].as_py())).values())


def test_overlaps_equal_plain_ones(monkeypatch):
    """Matrix products in chunks of columns give the common weight of every pair, repeated elements included."""
    monkeypatch.setattr(neardup, "CHUNK", 32)
    chance, base = random.Random(4), [f"w{k % 37}" for k in range(200)]
    texts = [" ".join(w if chance.random() > 0.05 else f"z{chance.randrange(30)}" for w in base) for _ in range(25)] + ["a b c d e f " * 30] * 2 + ["q"]
    found = list(neardup._bags_of(pa.array(texts)))
    row = np.repeat(np.arange(len(found)), [len(e) for e, _ in found])
    common = neardup.overlaps(row, np.concatenate([e for e, _ in found]), np.concatenate([w for _, w in found]).astype(np.int64), len(texts))
    bags = [bag(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            assert common[i, j] == sum((bags[i] & bags[j]).values())


@pytest.mark.parametrize("hubs", [True, False])
def test_many_blocks_and_members_without_hope(spark, monkeypatch, hubs):
    """A large group around the threshold, with blocks of a few texts, against all pairs; also with blocks alone."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    if not hubs:
        monkeypatch.setattr(neardup, "_hub_links", lambda left, texts: left.where("false").select(F.col("node").alias("a"), F.col("node").alias("b")))
    chance, base = random.Random(6), [f"w{k}" for k in range(150)]
    rows = []
    for k in range(120):
        words = list(base)
        for j in chance.sample(range(150), chance.choice([0, 1, 2, 3, 4, 6, 9])):
            words[j] = f"e{k}x{j}"
        rows.append((k, " ".join(words)))
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(near_classes(rows))


def test_near_classes_of_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in neardup.classes(odd).collect()), key=repr)
    assert got == sorted(near_classes(rows), key=repr)
    assert neardup.classes(none).count() == 0
    out = neardup.without_copies(odd)
    assert out.columns == odd.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([1, 3, 5, 7, 8, 9, None], key=repr)


def test_near_classes_of_chains(spark):
    """Members that miss the hub but hit another member, in one bucket and across rounds."""
    chance = random.Random(5)
    words = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(words))]
    for k in range(1, 30):
        spots = chance.sample(range(0, 200, 7), 2)
        words = [f"c{k}x{j}" if j in spots else w for j, w in enumerate(words)]
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(f"u{k}v{j}" for j in range(60))) for k in range(5)]
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(near_classes(rows))


def test_near_classes_of_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in neardup.classes(documents).collect())
    assert got == sorted(near_classes(rows))
