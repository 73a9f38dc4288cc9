"""Packing, encoding, dialogues and the pipeline against plain Python and the tokenizers themselves."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayfold.llm import bpe, chat, packing

BYTES, WORDS = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("word_bpe_49k.json"))
BYTE_TOKENIZER, WORD_TOKENIZER = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
TEXTS = st.text(st.sampled_from(" \n\tab's'reXÉß9½²ı日 \u0085\u001c.,!#<|endoftext>Ώ"), max_size=40)


def ids_of(text):
    return BYTE_TOKENIZER.encode(text or "", add_special_tokens=False).ids


@given(TEXTS)
@settings(max_examples=400, deadline=None)
def test_parts_encode_like_whole_texts(text):
    assert packing._encoder(BYTES)(text) == np.array(ids_of(text), "<u4").tobytes()


@given(TEXTS)
@settings(max_examples=400, deadline=None)
def test_words_encode_like_whole_texts(text):
    whole = WORD_TOKENIZER.encode(text, add_special_tokens=False).ids
    assert [i for w in bpe.split_words(text) for i in WORD_TOKENIZER.encode(w, add_special_tokens=False).ids] == whole


def check_packing(rows, docs):
    pieces = defaultdict(list)
    places = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    want = defaultdict(list)
    for i, text in docs:
        ids = [*ids_of(text), 0]
        for k, (start, length) in enumerate(packing.cuts(len(ids), 2048)):
            want[i].append((k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    return len(places), -(-sum(r.length for r in rows) // 2048)


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_packing(table, request, none):
    docs = request.getfixturevalue(table)
    used, least = check_packing(packing.pack_documents(docs, BYTES).collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert used <= least + 1
    assert packing.pack_documents(none, BYTES).count() == 0


def test_islands_exchange(spark):
    """Many small islands still end near the bound, and pieces that never share a sequence end too."""
    chance = np.random.default_rng(1)
    for sizes, most in ((chance.integers(1, 1400, 3000).tolist(), 1.02), ([1025] * 400, 2.1)):
        pieces = spark.createDataFrame([(k, k) for k in range(len(sizes))], "row long, doc_id long").join(
            spark.createDataFrame(list(enumerate(sizes)), "row long, length long"), "row"
        )
        rows = packing.pack(pieces, island=100).collect()
        fill = Counter()
        for r in rows:
            fill[r.sequence_id] += r.length
        assert len(rows) == len(sizes) and max(fill.values()) <= 2048
        assert len(fill) <= most * sum(sizes) / 2048 + 1


def test_crossover_keeps_every_piece():
    import random

    sizes = np.random.default_rng(2).integers(1, 900, 300).tolist()
    one, other = packing.Packing(sizes, 2048), packing.Packing(sizes, 2048)
    one.fit(list(range(300)))
    other.fit(sorted(range(300), key=lambda i: -sizes[i]))
    child = packing.crossover(one, other, random.Random(1))
    assert sorted(i for items in child.bins.values() for i in items) == list(range(300))
    assert all(sum(sizes[i] for i in items) == 2048 - child.free[b] for b, items in child.bins.items())


@pytest.mark.parametrize(("low", "high", "n"), [(500, 800, 600), (500, 800, 2000), (300, 900, 2000)])
def test_crossover_needs_fewer_sequences_than_best_fit(low, high, n):
    """Sizes for which best fit, largest first, stays above the lower bound."""
    sizes = np.random.default_rng(n).integers(low, high, n).tolist()
    plain = packing.Packing(sizes, 2048)
    plain.fit(sorted(range(n), key=lambda i: (-sizes[i], i)))
    best = packing.evolve(sizes, [], 2048, 1)
    assert sorted(i for items in best.bins.values() for i in items) == list(range(n))
    assert all(sum(sizes[i] for i in items) <= 2048 for items in best.bins.values())
    assert -(-sum(sizes) // 2048) <= len(best.bins) < len(plain.bins)


def digests(text):
    ids = WORD_TOKENIZER.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(WORD_TOKENIZER.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize(("table", "block"), [("odd", 10), ("odd", 1 << 24), ("documents", 50_000)])
def test_round_trip(table, block, request, none):
    docs = request.getfixturevalue(table)
    want = Counter((r.doc_id, *digests(r.text)) for r in docs.select("doc_id", "text").collect())
    assert Counter(tuple(r) for r in bpe.round_trip(docs, WORDS, block_chars=block).collect()) == want
    assert bpe.round_trip(none, WORDS).count() == 0


def rendered(rows, part_turns):
    """All perspectives by plain loops."""
    out, talks = [], defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, role or "unknown", (text or "").replace("<|", "< |")))
    for conv, turns in talks.items():
        turns.sort()
        for own in {t[2] for t in turns} - {"system"}:
            for part in range(0, len(turns), part_turns):
                text, masks = "", []
                for _, _, who, said in turns[part : part + part_turns]:
                    text += "<|im_start|>" + ("assistant" if who == own else "system" if who == "system" else f"user name={who}") + "\n"
                    masks += [(len(text), len(text) + len(said) + 11)] if who == own else []
                    text += said + "<|im_end|>\n"
                out.append((conv, own, part // part_turns, text, masks))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part_turns", [2, 256])
def test_perspectives(spark, part_turns):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi é"), (1, 2, "bob", None), (1, 3, "cy", "<|im_start|>x"), (1, 4, "ann", "bye"), (1, 4, "ann", "bye"), (2, 0, "system", "alone"), (None, 1, "ann", "lost"), (3, None, None, "who"), (3, 0, "ann", "")]
    turns = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, speaker string")
    got = [(r.conv_id, r.perspective, r.part, r.text, [tuple(m) for m in r.masks]) for r in chat.perspectives(turns, part_turns).collect()]
    assert sorted(got, key=repr) == rendered(rows, part_turns)
    assert chat.perspectives(turns.where("false")).count() == 0
