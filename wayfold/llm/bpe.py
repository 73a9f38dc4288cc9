"""BPE encoding and decoding through a table of distinct words.

Texts are split into the tokenizer's own words and become lists of places in a local word
list, one per block of about ``BLOCK_CHARS`` characters. The words of all blocks meet in one
table of distinct words, each is encoded once, and its ids are joined back to the blocks'
lists. There every id is joined with its piece in the id-to-piece table, the vocabulary,
which has a fixed size and comes with the task, and every text is put together by position.

What shuffles is one row per block and distinct word, and short compressed lists of
places; texts themselves stay where they are read. No word can become hot, as it has one
row a block.

Words are split here only in texts of plain Latin letters, digits, punctuation and white
space, where the rules are few. Any other text, and one that holds a special token's
first characters, is split at white space only and its parts are encoded whole, by the
same table; both give what the tokenizer gives for the whole text.

Null and empty texts have no ids and decode to the empty text. Repeated rows and null ids
come back as they are. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructField, StructType

from wayfold.storage import cut

BLOCK_CHARS = 24_000_000
#: Texts whose places are compressed together.
TOGETHER = 256

# The tokenizer's splitting rule on plain Latin text in lower case.
_LETTER = "a-zªµºß-öø-ÿĀ-ɏ"
_DIGIT = "0-9²³¹¼-¾"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^ \t-\r\u0085 {_LETTER}{_DIGIT}]+")
#: Anything that is not plain: control characters, and all beyond the Latin letters.
_OTHER = re.compile("[^\t-\r -~¡-¬®-¿À-Ö×Ø-įı-ɏ]|<\\|")
_BLANK = re.compile("[ \t-\r]+")


def split_words(text: str) -> list[str]:
    """Words that can be encoded one by one, in order."""
    if _OTHER.search(text) is None:
        return _WORD.findall(text.lower())
    return [part for part in _BLANK.split(text) if part]


def _places(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by falling frequency, and the order that brings them about."""
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return rank[words], order


def _packed(ranks: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Ranks as four compressed byte planes; the upper ones are nearly empty."""
    return squeeze.compress(ranks.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(blob: bytes, spread: zstandard.ZstdDecompressor) -> np.ndarray:
    planes = np.frombuffer(spread.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _blocks(batches, id_type: pa.DataType, block_chars: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """Rows (of, ids, lengths, places) of a block's texts, or rows (at, word) of its words.

    A block's number is its partition's and its own there; ``at`` is that number and the word's place in the block.
    """
    from pyspark import TaskContext

    squeeze = zstandard.ZstdCompressor(level=6)
    ids, lists, known, chars, number = [], [], {}, 0, 0
    part = TaskContext.get().partitionId() if TaskContext.get() else 0

    def block():
        all_words = np.concatenate(lists)
        ranks, order = _places(all_words, np.bincount(all_words, minlength=len(known)))
        name = part << 10 | number
        if texts:
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            for at in range(0, len(ids), TOGETHER):
                end = min(at + TOGETHER, len(ids))
                blob = _packed(ranks[ends[at] : ends[end]], squeeze)
                columns = [pa.array([name]), pa.array([ids[at:end]], pa.list_(id_type)), pa.array([np.diff(ends[at : end + 1])], pa.list_(pa.int32())), pa.array([blob])]
                yield pa.RecordBatch.from_arrays(columns, ["of", "ids", "lengths", "places"])
            return
        words = list(known)
        for at in range(0, len(order), 50_000):
            some = order[at : at + 50_000]
            columns = [pa.array((name << 32) + np.arange(at, at + len(some))), pa.array([words[k] for k in some], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["at", "word"])

    for batch in batches:
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = split_words(text) if text else []
            lists.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
            ids.append(id_)
            chars += len(text or "")
            if chars >= block_chars and number < 1023:  # the 1,024th block of a partition takes the rest
                yield from block()
                ids, lists, known, chars, number = [], [], {}, 0, number + 1
    if ids:
        yield from block()


_TOKENIZERS: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        _TOKENIZERS[path] = tokenizer
    return _TOKENIZERS[path]


def vocabulary(path: str) -> list[str]:
    """The id-to-piece table: each id's piece, special tokens included; its size is the vocabulary's."""
    pieces = _tokenizer(path).get_vocab(with_added_tokens=True)
    table = [""] * (max(pieces.values(), default=-1) + 1)
    for piece, i in pieces.items():
        table[i] = piece
    return table


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """Add ``ids``, as little-endian 32-bit numbers, to distinct words; the text comes from column ``word``."""

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            out = []
            for at in range(0, len(batch), 2000):
                found = tokenizer.encode_batch_fast(batch.iloc[at : at + 2000].tolist(), add_special_tokens=False)
                out += [np.array(e.ids, "<u4").tobytes() for e in found]
            yield pd.Series(out, index=batch.index, dtype=object)

    # Named nondeterministic so that no filter moves a second run of it below the grouping of the words.
    return words.withColumn("ids", ids.asNondeterministic()("word"))


def _joined(table: list[str]):
    """The function that puts a block's texts together: number of ids, and digests of ids and decoded form.

    ``table`` is the id-to-piece table. Every id of every word of the block is joined with its piece there.
    """

    def together(texts: pa.Table, words: pa.Table) -> pa.Table:
        place = words.column("place").to_numpy()
        size = int(place.max()) + 1 if len(place) else 0
        n, ids, decoded = np.zeros(size, np.int64), [""] * size, [""] * size
        for at, some in zip(place.tolist(), words.column("ids").to_pylist(), strict=True):
            numbers = np.frombuffer(some, "<u4").tolist()
            n[at], ids[at], decoded[at] = len(numbers), " ".join(map(str, numbers)), " ".join([table[i] for i in numbers])
        spread = zstandard.ZstdDecompressor()
        names, out = [], []
        for some_ids, lengths, blob in zip(texts.column("ids").to_pylist(), texts.column("lengths").to_pylist(), texts.column("places").to_pylist(), strict=True):
            names += some_ids
            for ranks in np.split(_unpacked(blob, spread), np.cumsum(lengths)[:-1]):
                some = ranks[n[ranks] > 0].tolist() if size else []
                out.append((int(n[some].sum()) if some else 0, _sha(" ".join([ids[r] for r in some])), _sha(" ".join([decoded[r] for r in some]))))
        columns = [pa.array(names, texts.schema.field("ids").type.value_type)]
        columns += [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
        return pa.Table.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return together


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def round_trip(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, stored: bool = False
) -> DataFrame:
    """Per document: doc_id, n_tokens, and the digests of its ids and of its decoded text.

    Texts are read twice, for their words and for their places, and must come in the same order both times.
    ``stored`` says that ``docs`` is a plain scan of a stored table, where they do; any other input is stored first.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows if stored else cut(rows, "texts")
    id_type = to_arrow_type(rows.schema["id"].dataType)
    text_kind = StructType([*StructType.fromDDL("of bigint"), StructField("ids", ArrayType(rows.schema["id"].dataType)), *StructType.fromDDL("lengths array<int>, places binary")])
    texts = rows.mapInArrow(lambda batches: _blocks(batches, id_type, block_chars, True), text_kind)
    words = rows.mapInArrow(lambda batches: _blocks(batches, id_type, block_chars, False), "at bigint, word string")
    # A word has one row a block, so what a word gathers is one number for each block.
    known = words.groupBy("word").agg(F.collect_list("at").alias("at"))
    placed = encode_words(known, path).select(F.explode("at").alias("at"), "ids")
    placed = placed.select(F.shiftright("at", 32).alias("block"), F.col("at").bitwiseAND(0xFFFFFFFF).alias("place"), "ids")
    found = StructType.fromDDL("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    kind = StructType([StructField("doc_id", rows.schema["id"].dataType), *found])
    return texts.groupBy("of").cogroup(placed.groupBy("block")).applyInArrow(_joined(vocabulary(path)), kind)
