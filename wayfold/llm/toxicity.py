"""Toxic passages by maximum-scoring segment search.

A token's score is its log-odds between toxic and clean labelled texts under a Dirichlet
prior in proportion to the pooled counts; a token whose log-odds are weak, or within ``Z``
standard errors of zero, gets a small negative score instead. Every maximal segment of positive
total score is found in one linear scan per text, and the scores of a text's segments are
aggregated by their extreme-value distribution: among n clean tokens the number of
segments above S is about K n exp(-lambda S). The surprise over all segments that are
significant there becomes a probability through a logistic curve, whose second input is the
text's length, because chance hits gather in long texts; a text without evidence gets the share of toxic
ones among such training texts.

Tokens are hashed into ``BUCKETS`` cells, so the model has a fixed size at any corpus
size. All counting and scoring covers whole texts. The classifier is fitted on at most
``train_rows`` labelled documents, those with the smallest hashes of their ids.

Null and empty texts have no tokens: they get the score of a text without evidence. A
null id takes no part in the training. Documents that repeat are scored each by itself,
to equal scores. Without any usable label (no toxic or no clean text) every document
scores 0. Only the id and text columns are read for a score, whatever other columns the
table has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfold.llm.words import ALNUM, LOWER, hashed_words, tidy
from wayfold.storage import cut

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: A token counts as evidence from this many standard errors and this log-odds on.
Z = 3.0
LEAST_ODDS = 1.0
#: Prior weight per pooled occurrence, and the score of a token without evidence.
PRIOR = 0.05
NEUTRAL = -0.05
TRAIN_ROWS = 100_000
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """Token scores, the extreme-value parameters and the logistic curve; at most 12 bytes a bucket."""

    buckets: np.ndarray
    weights: np.ndarray
    decay: float
    scale: float
    curve: tuple[float, float, float]  # slopes of evidence and length, and offset
    silent: float  # the score of a text without evidence


def held_out(id_col: Column) -> Column:
    """Whether a document stays out of the training: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, train_rows: int) -> DataFrame:
    """(text, toxic) of at most ``train_rows`` labelled documents that are not held out.

    The labels are cut to that number before they are broadcast, which bounds the broadcast.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic")).where("label_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(train_rows)
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(known), "label_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _count_tokens(batches):
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        toxic = np.asarray(batch.column(1)) > 0
        for row, end, hashes, words in hashed_words(batch.column(0), ALNUM, LOWER):
            kind = np.repeat(toxic[row:end], words)
            bucket = _bucket(hashes)
            for k in (0, 1):
                counts[k] += np.bincount(bucket[kind == bool(k)], minlength=BUCKETS)
    seen = np.flatnonzero(counts.sum(axis=0))
    for at in range(0, len(seen), 100_000):
        some = seen[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], ["bucket", "clean", "toxic"])
    del counts
    tidy()


def token_scores(clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log-odds per bucket under the prior; NEUTRAL where they are not significant."""
    pooled = clean + toxic
    prior = PRIOR * pooled
    mass = prior.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = toxic + prior, clean + prior
        odds = np.log(a / (toxic.sum() + mass - a)) - np.log(b / (clean.sum() + mass - b))
        error = np.sqrt(1 / a + 1 / b)
        return np.where((np.abs(odds) > np.maximum(Z * error, LEAST_ODDS)) & (pooled > 0), odds, NEUTRAL)


def decay_rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive solution of sum(share * exp(rate * score)) = 1."""
    if not (scores > 0).any() or (scores * share).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (share * np.exp(high * scores)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(middle * scores)).sum() < 1 else (low, middle)
    return low


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of one text, in one scan.

    Neighbours of equal sign are joined first. A candidate is merged with the nearest earlier
    one that starts lower, as long as that raises the total. Each candidate remembers that
    neighbour, and a search goes from one to the next, so the whole scan is linear.
    """
    if len(scores) == 0 or not (scores > 0).any():
        return []
    edges = np.flatnonzero(np.diff(scores > 0)) + 1
    starts = np.concatenate([[0], edges])
    ends = np.concatenate([edges, [len(scores)]])
    sums = np.add.reduceat(scores, starts)
    total, stack = 0.0, []  # each: total before, total after, first, end, place of the lower neighbour
    for first, end, value in zip(starts.tolist(), ends.tolist(), sums.tolist(), strict=True):
        before, total = total, total + value
        if value <= 0:
            continue
        after = total
        while True:
            at = len(stack) - 1
            while at >= 0 and stack[at][0] >= before:
                at = stack[at][4]
            if at < 0 or stack[at][1] >= after:
                stack.append((before, after, first, end, at))
                break
            before, first = stack[at][0], stack[at][2]
            del stack[at:]
    return [(first, end, after - before) for before, after, first, end, _ in stack]


def _table(buckets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    table = np.full(BUCKETS, NEUTRAL, np.float64)
    table[buckets] = weights
    return table


def _scored(column: pa.Array, table: np.ndarray):
    """Yield (tokens, segments) for each row of a text column."""
    for row, end, hashes, words in hashed_words(column, ALNUM, LOWER):
        scores = table[_bucket(hashes)]
        at = np.concatenate([[0], np.cumsum(words)])
        positive = np.add.reduceat(np.append(scores > 0, False), at[:-1]) if len(words) else []
        for k in range(end - row):
            n = int(words[k])
            yield n, segments(scores[at[k] : at[k + 1]]) if n and positive[k] else []


def evidence(n: int, found: list[tuple[int, int, float]], decay: float, scale: float) -> tuple[float, list]:
    """Total surprise in nats of a text's significant segments, and those segments.

    A segment is significant when fewer than one of its score is expected in the text by chance.
    """
    floor = np.log(max(scale * n, 1e-12))
    strong = [(a, b, decay * s - floor) for a, b, s in found if decay * s > max(floor, 0.0)]
    return sum(x for _, _, x in strong), strong


def _training_segments(buckets, weights, batches):
    table = _table(buckets, weights)
    for batch in batches:
        rows = list(_scored(batch.column(0), table))
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array([n for n, _ in rows], pa.int64()), pa.array([[s for _, _, s in x] for _, x in rows], pa.list_(pa.float64()))],
            ["toxic", "n", "scores"],
        )


def _logistic(x: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Slopes and offset of a logistic curve through binned counts, by Newton steps."""
    design = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    n, theta = clean + toxic, np.zeros(design.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        slope = design.T @ (toxic - n * p) - 1e-2 * theta
        bend = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(len(theta))
        theta = theta + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return max(float(theta[0]), 0.0), float(theta[1]), float(theta[2])


def probability(model: Model, total: float, n: int) -> float:
    """The score of a text of n tokens with this evidence, which grows without bound while the odds do not."""
    if total <= 0:
        return model.silent
    a, b, c = model.curve
    return float(1 / (1 + np.exp(-np.clip(a * np.log1p(total) + b * np.log1p(n) + c, -500, 500))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model | None:
    """The model from labelled documents that are not held out; None without both classes."""
    rows = training_rows(docs, labels, id_col, text_col, train_rows)
    counts = rows.mapInArrow(_count_tokens, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = counts.toArrow()  # at most BUCKETS rows
    bucket, clean, toxic = (found.column(c).to_numpy() for c in ("bucket", "clean", "toxic"))
    if clean.sum() == 0 or toxic.sum() == 0:
        return None
    scores = token_scores(clean.astype(float), toxic.astype(float))
    decay = decay_rate(scores, clean / clean.sum())
    known = scores != NEUTRAL
    buckets, weights = bucket[known], scores[known]
    seen = cut(rows.mapInArrow(lambda batches: _training_segments(buckets, weights, batches), "toxic int, n long, scores array<double>"), "segments")
    quiet = F.exp(-decay * F.coalesce(F.array_max("scores"), F.lit(0.0))) * F.col("n")
    base = seen.where("toxic = 0").agg(F.count("*").alias("docs"), F.sum(quiet).alias("quiet")).first()
    scale = float(base["docs"] / base["quiet"]) if base["quiet"] else 1.0
    floor = F.log(F.greatest(F.lit(scale) * F.col("n"), F.lit(1e-12)))
    over = F.transform(F.col("scores"), lambda s: F.when(decay * s > F.greatest(floor, F.lit(0.0)), decay * s - floor).otherwise(0.0))
    total = F.aggregate(over, F.lit(0.0), lambda a, b: a + b)
    # Counts per cell of evidence and length: both are logarithms, so the cells are few at any corpus size.
    cell = [F.round(F.log1p(total) * 20).cast("int").alias("evidence"), F.round(F.log1p("n") * 4).cast("int").alias("length")]
    classes = [F.sum(F.expr("int(toxic = 0)")).alias("clean"), F.sum(F.expr("int(toxic > 0)")).alias("toxic")]
    cells = seen.groupBy(*cell).agg(*classes).toPandas()
    loud = cells[cells["evidence"] > 0]
    curve = (1.0, 0.0, 0.0)
    if len(loud):
        x = np.stack([loud["evidence"].to_numpy() / 20, loud["length"].to_numpy() / 4], axis=1)
        curve = _logistic(x, loud["clean"].to_numpy(float), loud["toxic"].to_numpy(float))
    quiet_ones = cells[cells["evidence"] <= 0]
    silent = (quiet_ones["toxic"].sum() + 0.5) / (quiet_ones["toxic"].sum() + quiet_ones["clean"].sum() + 5)
    return Model(buckets, weights, decay, scale, curve, float(silent))


_FOUND = "score double, evidence double, n_tokens long, passages array<struct<first:long,end:long,surprise:double>>"


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Add to each document its score, evidence, number of tokens and significant passages (token positions).

    ``keep`` carries all columns of ``docs`` in a struct ``row``, whose text is read there; otherwise only the id comes along.
    """
    what = "row" if keep else "doc_id"
    place = docs.columns.index(text_col)
    rows = docs.select(F.struct("*").alias(what)) if keep else docs.select(F.col(id_col).alias(what), F.col(text_col).alias("text"))

    def scored(batches):
        table = None if model is None else _table(model.buckets, model.weights)
        for batch in batches:
            texts = batch.column(0).field(place) if keep else batch.column(1)
            out = []
            for n, found in [(0, [])] * batch.num_rows if model is None else _scored(texts, table):
                total, strong = evidence(n, found, model.decay, model.scale) if found else (0.0, [])
                p = 0.0 if model is None else probability(model, total, n)
                out.append((p, float(total), n, [{"first": a, "end": b, "surprise": float(x)} for a, b, x in strong]))
            kinds = [pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("surprise", pa.float64())]))]
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [what, "score", "evidence", "n_tokens", "passages"])
        tidy()

    return rows.mapInArrow(scored, StructType([rows.schema[0], *StructType.fromDDL(_FOUND)]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, and what the score rests on."""
    found = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "evidence",
        "n_tokens",
        "passages",
    )


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    found = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col, keep=True)
    return found.where(F.col("score") < THRESHOLD).select("row.*")
