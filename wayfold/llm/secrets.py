"""Secrets by the cost of guessing them.

Three plain patterns (assignments, access keys, hex runs) always count. Beyond them, values in
a credential context, such as ``pwd: ...``, ``passphrase is ...`` or ``Bearer ...``, are
measured: dynamic programming finds the cheapest way to put the value together from
dictionary words (by rank, with substitutions and capitals), dates, repeated blocks, keyboard
walks and brute-force spans, in log2 of guesses; a value of ``LEAST_BITS`` or more is a secret.
The dictionary is, after a short list of common passwords, the at most ``RANKS`` words that most distinct
texts hold, and at least ``LEAST_SHARE`` of them; copies count once, and neither plain patterns nor
the values of credential contexts are counted, so a secret cannot become a word by being copied.
Its size is a parameter of the model, so it is bounded.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Repeated rows
are searched each by itself, null ids come back as they are, and extra columns are not read
(``redact`` carries them along). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfold.llm.exact import maybe_repeated, repeated_cells
from wayfold.llm.words import tidy

RANKS = 20_000
#: A word of the dictionary is in this share of the distinct texts, whatever their number, and in this many.
LEAST_SHARE = 0.001
LEAST_TEXTS = 3
LEAST_BITS = 40.0
LEAST_LENGTH = 6
#: Longest word of the dictionary, and longest walk and repeated block that one segment may hold. Values of any length are
#: weighed whole, in time linear in their length.
LONGEST_WORD = 24
SEGMENT = 64
PLACEHOLDER = "[SECRET]"

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "context")

#: Credential contexts whose values are measured.
_CONTEXT_WORDS = ("pass", "pwd", "pin", "secret", "token", "bearer", "auth", "cred", "key", "login")
# A name is one of these words, as a part of any identifier: after a separator or a hump, before a separator, a hump or the end.
_NAME = (
    r"(?:(?<![A-Za-z])|(?<=[a-z0-9])(?=[A-Z]))"
    r"(?ai:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|auth(?:orization)?|login|"
    r"(?:api|access|private|client|session)[_\x20.-]?(?:key|secret|token))"
    r"(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?=s\b))"
)
# A quoted value ends at its closing quote; a bare one at white space, a quote, a tag, or a delimiter before the next name.
_QUOTED = r"""(?:"((?:\\.|[^"\\\n]){6,})"|'((?:\\.|[^'\\\n]){6,})'|`([^`\n]{6,})`)"""
_BARE = r"""((?:(?![,;&|][A-Za-z_][\w.-]*[=:]|</)[^\s"'`]){6,})"""
NAME = re.compile(_NAME)
#: A whole identifier and what leads to its value. Each identifier is read once, however long it is.
HEAD = re.compile(r"""(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]++(?=(["'`\]]{0,2}\x20*(?:[:=]>?|\x20is\x20|\x20was\x20)\x20*))""")
VALUE = re.compile(rf"""(?ai:(?:bearer|basic)\x20+)?(?:{_QUOTED}|["'`]?{_BARE})""")
BEARER = re.compile(rf"""(?ai:\bbearer\x20+){_BARE}""")
_WORD_BEFORE = 16
#: A value that names an account and is no secret where the context asks for one.
_ACCOUNT = re.compile(r"(?ai:login|auth)")
_ADDRESS = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")

# Common passwords, the most common first.
COMMON = (
    "password", "123456", "qwerty", "letmein", "admin", "welcome", "monkey", "dragon", "master", "login",
    "abc123", "iloveyou", "football", "shadow", "sunshine", "princess", "trustno1", "passw0rd", "changeme", "secret",
    "example", "default", "test", "guest", "root", "user", "demo", "sample", "dummy", "placeholder",
)
# The rows of a keyboard and characters that stand for letters.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
STANDS_FOR = str.maketrans("@4301$57", "aaeoisst")
_SAME_ROW = {(a, b) for row in KEY_ROWS for a, b in [*zip(row, row[1:], strict=False), *zip(row[1:], row, strict=False)]}
_NEXT = _SAME_ROW | {(a, b) for one, two in zip(KEY_ROWS, KEY_ROWS[1:], strict=False) for a, b in [*zip(one, two, strict=False), *zip(two, one, strict=False)]}
_DATE = re.compile(r"(?a:(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d)")


def guess_bits(value: str, ranks: dict[str, int]) -> float:
    """log2 of the guesses that the cheapest segmentation of a value needs."""
    pool = sum(size for size, found in ((26, r"[a-z]"), (26, r"[A-Z]"), (10, r"[0-9]"), (33, r"[^a-zA-Z0-9]")) if re.search(found, value))
    return _cheapest(value, ranks, math.log2(max(pool, 10)), {})


def word_bits(part: str, ranks: dict[str, int]) -> float:
    """The cost of a dictionary word by its rank, with substitutions and capitals; infinite for others."""
    word = part.lower()
    rank, extra = ranks.get(word), 0.0
    if rank is None:
        plain = word.translate(STANDS_FOR)
        rank = ranks.get(plain) if plain != word else None
        extra = 1.0 + sum(a != b for a, b in zip(word, plain, strict=True))
    if rank is None:
        return math.inf
    capitals = 0.0 if part == word else 1.0 if part[0].isupper() and part[1:] == word[1:] or part.isupper() else float(sum(c.isupper() for c in part))
    return math.log2(rank + 1) + extra + capitals


def date_bits(part: str) -> float:
    return math.log2(365 * 120) + 2 * any(c in "-/._" for c in part) if _DATE.fullmatch(part) else math.inf


def walk_bits(length: int, turns: int) -> float:
    """The cost of a walk over the keyboard: its first key, length and turns between rows."""
    return math.log2(47) + math.log2(length) + 2 * turns + 1


def _cheapest(value: str, ranks: dict[str, int], per_char: float, known: dict[str, float]) -> float:
    """The cost of the best segmentation. A segment costs one bit beside its own; a repeated block costs what the block costs, and
    the logarithm of its repetitions."""
    if value in known:
        return known[value]
    n, low = len(value), value.lower()
    best = [0.0] + [math.inf] * n
    same = [0] * (SEGMENT + 1)  # per block length: how many characters up to here equal those a block before
    walk: list[int] = []  # turns since the start of the walk that ends here, one number a step
    for end in range(1, n + 1):
        found = best[end - 1] + per_char  # brute force, one more character
        for length in range(3, min(LONGEST_WORD, end) + 1):
            cost = word_bits(value[end - length : end], ranks)
            if cost < math.inf:
                found = min(found, best[end - length] + cost + 1)
        if low[end - 1].isdecimal():
            for length in range(4, min(10, end) + 1):
                cost = date_bits(value[end - length : end])
                if cost < math.inf:
                    found = min(found, best[end - length] + cost + 1)
        if end > 1 and (low[end - 2], low[end - 1]) in _NEXT:
            walk = (walk + [0])[-SEGMENT:]
            turn = (low[end - 2], low[end - 1]) not in _SAME_ROW
            walk = [t + turn for t in walk]
            for steps in range(2, len(walk) + 1):
                found = min(found, best[end - steps - 1] + walk_bits(steps + 1, walk[-steps]) + 1)
        else:
            walk = []
        for size in range(1, min(SEGMENT, end - 1) + 1):
            same[size] = same[size] + 1 if value[end - 1] == value[end - 1 - size] else 0
            if same[size] < size:
                continue
            most = same[size] // size + 1
            for times in {most, *range(2, min(most, max(SEGMENT // size, 2)) + 1)}:
                start = end - times * size
                # A block that repeats a smaller one is dearer than more of that one.
                if times * size >= 3 and not any(size % d == 0 and same[d] >= times * size - d for d in range(1, size // 2 + 1)):
                    cost = _cheapest(value[start : start + size], ranks, per_char, known)
                    found = min(found, best[start] + cost + math.log2(times) + 1)
        best[end] = found
    known[value] = best[n]
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain patterns: leftmost matches that do not overlap, then filtered."""
    found = []
    low = text.lower()
    if any(word in low for word in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _values(text: str) -> list[tuple[int, int]]:
    """(start, end) of all values in credential contexts."""
    low = text.lower()
    if not any(word in low for word in _CONTEXT_WORDS):
        return []
    found, at = [], 0
    while head := HEAD.search(text, at):
        at = head.end(1)
        # The word before belongs to a name of two words, such as "api key".
        names = [m for m in NAME.finditer(text, max(head.start() - _WORD_BEFORE, 0), head.end()) if m.end() > head.start()]
        value = VALUE.match(text, at) if names else None
        if value is None:
            at = max(head.end(), head.start() + 1)
            continue
        start, end = value.span(value.lastindex)
        if value.lastindex > 3:  # bare, maybe before the end of a sentence or a bracket
            end = start + len(text[start:end].rstrip(".,;:)]}>"))
        at = value.end()
        account = _ACCOUNT.match(names[-1][0]) and _ADDRESS.fullmatch(text, start, end)
        if end - start >= LEAST_LENGTH and not account:
            found.append((start, end))
    for m in BEARER.finditer(text):
        start = m.start(1)
        end = start + len(m[1].rstrip(".,;:)]}>"))
        if end - start >= LEAST_LENGTH and not any(a < end and start < b for a, b in found):
            found.append((start, end))
    return sorted(found)


def context_spans(text: str, ranks: dict[str, int]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of values in credential contexts that are dear to guess."""
    return [(a, b, "context") for a, b in _values(text) if guess_bits(text[a:b], ranks) >= LEAST_BITS]


def secret_spans(text: str, ranks: dict[str, int]) -> list[tuple[int, int, str]]:
    """All spans by start, then kind; a context span is left out where a base span covers it."""
    base = base_spans(text)
    more = [c for c in context_spans(text, ranks) if not any(b[0] <= c[0] and c[1] <= b[1] for b in base)]
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _plain_words(text: str) -> set[str]:
    """The words of a text outside its plain patterns and the values of its credential contexts."""
    at, parts = 0, []
    for start, end in sorted([*((a, b) for a, b, _ in base_spans(text)), *_values(text)]):
        parts.append(text[at : max(start, at)])
        at = max(at, end)
    words = set(re.findall(r"[^\W\d_]+", " ".join([*parts, text[at:]]).lower()))
    return {w for w in words if 3 <= len(w) <= LONGEST_WORD}


def _count_words(batches):
    """In how many of the texts every word is; the empty word is in each."""
    counts = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(_plain_words(text))
            counts[""] += 1
            if len(counts) > 200_000:
                yield _counted(counts)
                counts = Counter()
    if counts:
        yield _counted(counts)
    del counts
    tidy()


def _counted(counts):
    return pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every text once; only texts whose digest may be repeated are shuffled."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.sha2(F.col(text_col), 256).alias("digest"))
    flagged = maybe_repeated(rows, "digest", repeated_cells(rows.select("digest"), "digest"), "maybe")
    again = flagged.where("maybe").groupBy("digest").agg(F.first("text").alias("text"))
    return flagged.where(~F.col("maybe")).select("text").unionByName(again.select("text"))


def dictionary(docs: DataFrame, text_col: str = "text", size: int = RANKS) -> dict[str, int]:
    """Ranks from 1: common passwords, then at most ``size`` words by the number of distinct texts that hold them."""
    words = distinct_texts(docs, text_col).mapInArrow(_count_words, "word string, n long")
    top = words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "word").limit(size + 1).collect()
    every = max((r["n"] for r in top if not r["word"]), default=0)
    ranks: dict[str, int] = {}
    for word in (*COMMON, *(r["word"] for r in top if r["word"] and r["n"] >= LEAST_SHARE * every)):
        ranks.setdefault(word, len(ranks) + 1)
    return ranks


def scan(docs: DataFrame, ranks: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and its spans (start, end, kind, bits of guessing)."""
    ranks = dictionary(docs, text_col) if ranks is None else ranks
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def search(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("bits", pa.float64())]))
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                spans = secret_spans(text, ranks) if text else []
                out.append([{"start": a, "end": b, "kind": k, "bits": guess_bits(_value(text[a:b], k), ranks)} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])
        tidy()

    found = StructType.fromDDL("spans array<struct<start:bigint,end:bigint,kind:string,bits:double>>")
    return rows.mapInArrow(search, StructType([rows.schema[0], *found]))


def _value(found: str, kind: str) -> str:
    """The guessable part of a span: an assignment's value, the whole span otherwise."""
    match = ASSIGN.match(found) if kind == "assign" else None
    return match[1] if match else found


def redact(docs: DataFrame, ranks: dict[str, int] | None = None, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents with every secret replaced by a placeholder, all columns kept, ``chars_col`` counted anew."""
    ranks = dictionary(docs, text_col) if ranks is None else ranks

    def replace(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [_redacted(text, ranks) if text else text for text in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        tidy()

    clean = docs.mapInArrow(replace, docs.schema)
    if chars_col not in docs.columns:
        return clean
    return clean.withColumn(chars_col, F.length(F.col(text_col)).cast(docs.schema[chars_col].dataType)).select(*docs.columns)


def _redacted(text: str, ranks: dict[str, int]) -> str:
    parts, at = [], 0
    for start, end, kind in secret_spans(text, ranks):
        if kind == "assign":  # the name stays, its value goes
            start = end - len(_value(text[start:end], kind))
        if start < at:  # overlaps the last one: that placeholder stands for both
            at = max(at, end)
            continue
        parts += [text[at:start], PLACEHOLDER]
        at = end
    return "".join([*parts, text[at:]])


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "context")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(told(base), 256).alias("base_sha256"),
        told("spans").alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["bits"])), F.lit(0.0)).alias("most_bits"),
    )
