"""Licence texts by canonical digest, in DataFrame operations only.

A text is brought to one form (lower case, no copyright lines, no list marks, no
punctuation, one spelling for equivalent words) and digested whole; the digest is joined
to the digests of known licences, then that of the text without lines of holders that have no year.
The known table is a parameter; its default is
``KNOWN``. Its digests are broadcast only when it has at most ``SMALL`` rows, and joined by
shuffle otherwise.

Null and empty texts, and texts of nothing but copyright lines and punctuation, are
canonically empty: they get a digest and never a licence. A document whose text equals
several known licences gets the one that sorts first. Repeated rows are answered each by
itself; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL = 10_000

# Spellings that licence guidelines treat as equal, as whole words.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("honour", "honor"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

#: Lines that name a holder or reserve rights, and marks at the start of a line.
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*(copyright[ \t]*(\(c\)|©|[0-9<\[{])|\(c\)|©|all rights reserved)[^\n]*$"
#: Lines that name a holder without a year, unlike a wrapped line that goes on about copyright.
_NO_HOLDER = (
    r"(?:notices?|holders?|owners?|ownership|laws?|licen[sc]es?|acts?|and|or|in|is|are|as|to|on|of|"
    r"for|interests?|statements?|protections?|treat(?:y|ies)|disclaimers?|information|claims?|status|rights?|permissions?)"
)
HOLDER_LINE = rf"(?m)^[ \t*#/;-]*copyright[ \t]*[:,]?[ \t]+(?!{_NO_HOLDER}\b)[^\n]+$"
LIST_MARK = r"(?m)^[ \t]*([*#/;-]+|\(?[0-9a-z][.)])[ \t]+"


def canonical(text: Column) -> Column:
    """The canonical form: words between double spaces, so every word has its own borders."""
    form = F.lower(F.coalesce(text, F.lit("")))
    form = F.regexp_replace(form, COPYRIGHT_LINE, "")
    form = F.regexp_replace(form, LIST_MARK, "")
    form = F.replace(form, F.lit("&"), F.lit(" and "))
    form = F.concat(F.lit(" "), F.regexp_replace(form, "[^0-9a-z\u0080-\U0010ffff]+", "  "), F.lit(" "))
    for other, one in EQUIVALENT:
        form = F.replace(form, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.trim(form)


def digest(text: Column) -> Column:
    """Hex SHA-256 of the canonical form."""
    return F.sha2(canonical(text), 256)


def nameless_digest(text: Column, canonical_sha256: Column) -> Column:
    """The digest without lines of holders that have no year; the canonical one, as given, without such lines."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = F.contains(low, F.lit("copyright")) & low.rlike(HOLDER_LINE)
    return F.when(named, digest(F.regexp_replace(low, HOLDER_LINE, ""))).otherwise(canonical_sha256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """The default table (license_id, text): every text without a title and under each published one."""
    from wayfold.llm.license_texts import KNOWN, TITLES

    rows = [(k, f"{title}\n\n{text}") for k, text in KNOWN.items() for title in ("", *TITLES[k])]
    return spark.createDataFrame(rows, "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, canonical_sha256, license_id (null where the text is no known licence)."""
    known = known_licenses(docs.sparkSession) if known is None else known
    sides = (
        known.select(digest(F.col("text")).alias("known_sha256"), F.col("license_id"), canonical(F.col("text")).alias("form"))
        .where("form <> ''")
        .groupBy("known_sha256")
        .agg(F.min("license_id").alias("license_id"))
    )
    small = known.limit(SMALL + 1).count() <= SMALL
    if small:
        sides = F.broadcast(sides)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), digest(text).alias("canonical_sha256"))
    rows = rows.select("doc_id", "canonical_sha256", nameless_digest(F.col("text"), F.col("canonical_sha256")).alias("nameless_sha256"))
    other = sides.select(F.col("known_sha256").alias("other_sha256"), F.col("license_id").alias("other_id"))
    found = rows.join(sides, F.col("canonical_sha256") == F.col("known_sha256"), "left")
    found = found.join(F.broadcast(other) if small else other, F.col("nameless_sha256") == F.col("other_sha256"), "left")
    return found.select("doc_id", "canonical_sha256", F.coalesce("license_id", "other_id").alias("license_id"))


def twin_sql(known: dict[str, str]) -> str:
    """The same in SQL, with the known texts, without a title and under each published one, as values."""
    from wayfold.llm.license_texts import TITLES

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [(k, f"{title}\n\n{text}") for k, text in known.items() for title in ("", *TITLES.get(k, ()))]
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in rows)
    # This dialect's patterns can't look ahead, so a line is a holder's when one pattern is found and another is not.
    start = r"^[ \t*#/;-]*copyright"
    holder = rf"regexp_matches(x, '{start}[ \t]*[:,]?[ \t]+[^\n]') AND NOT regexp_matches(x, '{start}(?:[ \t]*[:,])?[ \t]{_NO_HOLDER}\b')"
    return f"""
WITH k AS (
  SELECT sha256(form) AS h, min(license_id) AS license_id
  FROM (SELECT license_id, {_form_sql("text")} AS form FROM (VALUES {values}) AS t(license_id, text)) WHERE form <> '' GROUP BY 1
), lines AS (
  SELECT doc_id, text, array_to_string(list_transform(string_split(lower(coalesce(text, '')), chr(10)),
      lambda x: CASE WHEN {holder} THEN '' ELSE x END), chr(10)) AS nameless FROM documents
), d AS (
  SELECT doc_id, sha256({_form_sql("text")}) AS canonical_sha256, sha256({_form_sql("nameless")}) AS nameless_sha256 FROM lines
)
SELECT doc_id, canonical_sha256, coalesce(k.license_id, other.license_id) AS license_id
FROM d LEFT JOIN k ON k.h = canonical_sha256 LEFT JOIN k other ON other.h = nameless_sha256
"""


def _form_sql(text: str) -> str:
    """``canonical`` of a column in SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"regexp_replace(regexp_replace(lower(coalesce({text}, '')), {quoted(COPYRIGHT_LINE)}, '', 'g'), {quoted(LIST_MARK)}, '', 'g')"
    form = f"' ' || regexp_replace(replace({form}, '&', ' and '), '[^0-9a-z\u0080-\U0010ffff]+', '  ', 'g') || ' '"
    return f"trim({reduce(lambda f, pair: f"replace({f}, ' {pair[0]} ', ' {pair[1]} ')", EQUIVALENT, form)}, ' ')"
