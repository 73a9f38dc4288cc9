"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Every document gets plain counts from its words, and a score: the mean over its one- and
two-word features of log(p_trusted / p_raw), where both are multinomials over ``BUCKETS``
hashed features. The raw corpus is every document; the trusted ones are documents whose
label says quality 1: three quarters of them for the counts, the rest, which no count has seen, for the threshold.
Scores are sums of whole numbers (ten-thousandths of a nat), so they do not
depend on the order of summation, and a document is kept when its mean reaches a threshold
that all but ``TAIL`` of those other trusted documents reach.

The model is ``BUCKETS`` whole numbers at any corpus size, held as one constant array. Counts
are combined before the shuffle and the rest is per row. Raw counts need no join. A Bloom filter of fixed size leaves
trusted documents, and few others, to the join with the trusted ids, and what it finds is stored once for the trusted
counts and the threshold; so at every size only texts of trusted documents can be shuffled.

Words are runs of anything but space and the control characters 9 to 13. Null and empty
texts have no words, fail the base rules and are dropped. A null id is never trusted.
Repeated rows count and are judged each by itself. Without trusted texts every score is 0
and the base rules alone decide. Extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.exact import maybe_repeated, repeated_cells
from wayfold.storage import cut

BUCKETS = 1 << 14
UNIT = 10_000
SMOOTHING = 1.0
TAIL = 0.005
LEAST_WORDS = 10
MOST_REPEATED = 0.2
WINDOW = 5
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Model:
    """Log ratios per bucket in units of 1 / UNIT, and the least mean that is kept."""

    ratios: tuple[int, ...]
    threshold: float


def words(text: Column) -> Column:
    """The words of a text; none for a null text."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def with_features(docs: DataFrame) -> DataFrame:
    """Add to (text, ...) the words' hashes ``w`` and the feature buckets ``f`` of one and two words."""
    hashed = docs.withColumn("w", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)))
    n = F.size("w")
    pairs = F.zip_with(F.slice("w", 1, F.greatest(n - 1, F.lit(0))), F.slice("w", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)))
    return hashed.withColumn("f", F.concat(F.transform("w", lambda a: F.pmod(a, F.lit(BUCKETS))), pairs))


def exploded_features(docs: DataFrame) -> DataFrame:
    """(bucket): the same features of (text), one a row, by expressions that Spark compiles."""
    one = words(F.col("text"))
    pairs = docs.select(one.alias("a")).select(F.explode(F.arrays_zip("a", F.slice("a", 2, F.greatest(F.size("a"), F.lit(1))).alias("b"))).alias("p"))
    hashed = pairs.select(F.xxhash64("p.a").alias("a"), F.when(F.col("p.b").isNotNull(), F.xxhash64("p.b")).alias("b"))
    both = F.array(F.pmod("a", F.lit(BUCKETS)), F.when(F.col("b").isNotNull(), F.pmod(F.xxhash64("a", "b"), F.lit(BUCKETS))))
    return hashed.select(F.explode(both).alias("bucket")).where("bucket IS NOT NULL")


def _mean_ratio(ratios: tuple[int, ...]) -> Column:
    """The mean log ratio of the features ``f``; 0 without features."""
    # A cast of a constant is folded while the query is planned; a lambda would run for every feature.
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")
    total = F.aggregate("f", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b.cast("int")))
    return F.when(F.size("f") > 0, total / (F.size("f") * F.lit(UNIT))).otherwise(F.lit(0.0))


def window_hashes(w: Column) -> Column:
    """A hash for each run of WINDOW words, given the words' hashes; none in shorter texts."""
    n = F.size(w)
    at = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    places = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, at)


def _lined_up(windows: Column) -> Column:
    """(hash, place) of the windows in order, so equal ones are neighbours; none if all differ."""
    line = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    alike = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(alike, line).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _repeated(line: Column) -> Column:
    """Sorted places of the windows that equal a neighbour in ``line`` (a stored column: it is read per element)."""
    same = lambda x, k: F.get(line, k)["h"] == x["h"]
    places = F.transform(line, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
    return F.array_sort(F.filter(places, lambda i: i.isNotNull()))


def _span(places: Column) -> Column:
    """Words in windows that start at these sorted places."""
    n = F.size(places)
    steps = F.zip_with(
        F.slice(places, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(places, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.least(b - a, F.lit(WINDOW)),
    )
    return F.when(n > 0, F.aggregate(steps, F.lit(WINDOW), lambda a, b: a + b)).otherwise(F.lit(0))


def base_counts(docs: DataFrame) -> DataFrame:
    """Add the counts of words, characters, symbols, repeated lines and repeated windows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, _BLANKS, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _BLANKS, "") != "")
    staged = docs.withColumns({"lines": lines, "windows": window_hashes(F.col("w"))})
    staged = staged.withColumn("line", _lined_up(F.col("windows"))).withColumn("places", _repeated(F.col("line")))
    return staged.withColumns(
        {
            "n_words": F.size("w").cast("long"),
            "word_chars": F.length(bare).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": _span(F.col("places")).cast("long"),
        }
    )


def _trusted(labels: DataFrame) -> DataFrame:
    """Ids of all trusted documents, and which are set aside."""
    known = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("trusted_id")).distinct()
    return known.withColumn("aside", F.pmod(F.xxhash64(F.lit(1), "trusted_id"), F.lit(4)) == 0)


def _tail(scores: DataFrame) -> float | None:
    """The score that all but TAIL of the rows of (mean) reach, in steps of 1 / UNIT, from a histogram of them all."""
    steps = scores.select(F.floor(F.col("mean") * UNIT).alias("step")).groupBy("step").count().orderBy("step").collect()  # bounded by the ratios' range
    left = TAIL * (sum(r["count"] for r in steps) - 1)
    for r in steps:
        left -= r["count"]
        if left < 0:
            return r["step"] / UNIT
    return None


def _trusted_texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(text, aside) of the trusted documents among (id, text), stored."""
    ids = cut(ids, "trusted")
    filters = cut(repeated_cells(ids.select(_digest(F.col("trusted_id")).alias("digest")), "digest", least=1), "cells")
    some = maybe_repeated(rows.withColumn("digest", _digest(F.col("id"))), "digest", filters, "maybe").where("maybe")
    # Always the same join: the ids outgrow a broadcast, and a plan that turns with their size moves texts in a jump.
    return cut(some.join(ids.hint("merge"), F.col("id") == F.col("trusted_id")).select("text", "aside"), "known")


def _digest(name: Column) -> Column:
    return F.sha2(name.cast("string"), 256)


def _counts(texts: DataFrame) -> list[int]:
    """How often each of the BUCKETS features is in (text)."""
    out = [0] * BUCKETS
    for r in exploded_features(texts).groupBy("bucket").count().collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["count"]
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Feature ratios from all documents against the trusted ones, and the threshold."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = _trusted_texts(rows, _trusted(labels))
    raw = _counts(rows.select("text"))
    good = _counts(known.where("NOT aside").select("text"))
    all_raw, all_good = sum(raw), sum(good)
    if not all_good:
        return Model((0,) * BUCKETS, 0.0)
    ratios = tuple(
        round(UNIT * (math.log((g + SMOOTHING) / (all_good + SMOOTHING * BUCKETS)) - math.log((r + SMOOTHING) / (all_raw + SMOOTHING * BUCKETS))))
        for g, r in zip(good, raw, strict=True)
    )
    seen = with_features(known.where("aside").select("text")).where(F.size("w") >= LEAST_WORDS)
    threshold = _tail(seen.select(_mean_ratio(ratios).alias("mean")))
    return Model(ratios, threshold if threshold is not None else 0.0)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, the counts, base_failed, score, threshold and kept."""
    model = fit(docs, labels, id_col, text_col)
    rows = with_features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    scored = base_counts(rows).withColumn("score", _mean_ratio(model.ratios))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > round(100 * MOST_REPEATED) * F.col("n_words"))
    return scored.withColumns({"base_failed": failed, "threshold": F.lit(model.threshold)}).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "score",
        "threshold",
        (~F.col("base_failed") & (F.col("score") >= F.col("threshold"))).alias("kept"),
    )
