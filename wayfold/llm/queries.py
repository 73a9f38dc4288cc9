"""The registered queries of the operators of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import (
    bpe, chat, exact, html, importable, licenses, mixing, neardup, packing, periodic, quality, ranked, secrets, toxicity,
)
from wayfold.llm.license_texts import KNOWN

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation from every participant's point of view; masks as start:end,... text."""
    found = chat.perspectives(_table(spark, folder, "conversations"))
    spans = F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string")))
    return found.withColumn("masks", F.array_join(spans, ","))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(_table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality counts and verdicts of all documents."""
    return quality.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.digest(secrets.scan(_table(spark, folder, "documents")))


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of near duplicates over all documents."""
    return neardup.classes(_table(spark, folder, "documents"))


def op7_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract(_table(spark, folder, "pages"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact.mark_copies(_table(spark, folder, "documents"))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    return bpe.round_trip(_table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"), stored=True)


def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence digests of all documents."""
    return licenses.scan(_table(spark, folder, "documents"))


def op11_periodic(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in all documents."""
    return periodic.periodic_runs(_table(spark, folder, "documents"), change=periodic.planted)


def op12_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with what the mix takes of each and when."""
    mixed = mixing.mix(_table(spark, folder, "documents"))
    return mixed.withColumns({c: F.round(c, 9) for c in ("position", "again")})


def op13_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The best documents for every benchmark item."""
    return ranked.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'),
                            replace(coalesce(text, ''), '<|', '< |')) - 1 AS n
  FROM conversations
), p AS (
  SELECT DISTINCT conv_id AS of, speaker AS perspective FROM t WHERE speaker <> 'system'
), m AS (
  SELECT conv_id, perspective, n // 256 AS part, n, speaker = perspective AS target, body || '<|im_end|>' || chr(10) AS body,
         CASE WHEN speaker = perspective THEN '<|im_start|>assistant' WHEN speaker = 'system' THEN '<|im_start|>system'
              ELSE '<|im_start|>user name=' || speaker END || chr(10) AS head
  FROM t JOIN p ON conv_id IS NOT DISTINCT FROM of
), e AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY n) AS until FROM m
)
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (target) AS n_target,
       string_agg(head || body, '' ORDER BY n) AS text,
       coalesce(string_agg((until - length(body))::BIGINT || ':' || until::BIGINT, ',' ORDER BY n) FILTER (target), '') AS masks
FROM e GROUP BY conv_id, perspective, part
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""

QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_perspectives": op2_perspectives,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_secrets": op5_secrets,
    "op6_near_dedup": op6_near_dedup,
    "op7_html": op7_html,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_bpe": op9_bpe,
    "op10_licenses": op10_licenses,
    "op11_periodic": op11_periodic,
    "op12_mixing": op12_mixing,
    "op13_ranked": op13_ranked,
}
TWINS: dict[str, str] = {
    "op2_perspectives": OP2_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op10_licenses": licenses.twin_sql(KNOWN),
    "op12_mixing": mixing.SQL,
}
