"""Typed records of e-mail creatives, and measurable features of their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.functions.rules import any_of, first_match
from wayfold.functions.text import strip_suffix, upper_fields

# The fields of a creative record with their types and defaults.
RECORD_FIELDS: list[tuple[str, str, object]] = [
    ("file_name", "string", ""),
    ("subject", "string", ""),
    ("subject_length", "int", 0),
    ("email_tone", "string", ""),
    ("email_type", "string", ""),
    ("body_tone", "string", ""),
    ("body_type", "string", ""),
    ("body_length", "int", 0),
    ("campaign_body", "string", ""),
    ("offer_flag", "boolean", False),
    ("offer_type", "string", ""),
    ("offer", "string", ""),
    ("offer_value", "string", "0"),
    ("cta_order_now", "boolean", False),
    ("cta_visit_restaurant", "boolean", False),
    ("image_flag", "boolean", False),
    ("image", "string", ""),
    ("image_item", "string", ""),
    ("color_theme", "boolean", False),
]
UPPER_FIELDS = [
    "subject", "email_type", "email_tone", "body_type", "body_tone", "image", "image_item", "offer_type",
]

# Label sets and the words that decide them, first match wins.
EMAIL_TONES = {
    "Promotional": ("offer", "discount", "free", "sale"),
    "Informative": ("news", "update", "information"),
    "Convincing": ("best", "must", "now"),
}
EMAIL_TYPES = {
    "Transactional": ("order", "receipt", "payment"),
    "Survey": ("survey", "feedback", "rate us"),
    "Informational": ("information", "update", "notice"),
    "Newsletter": ("newsletter", "weekly", "monthly"),
}
BODY_TONES = {
    "Friendly": ("hello", "dear", "thanks"),
    "Convincing": ("best", "must", "now"),
    "Inspirational": ("dream", "inspire"),
    "Professional": ("regards", "sincerely"),
}
BODY_TYPES = {
    "Reminder": ("remind", "last chance", "expires"),
    "Announcement": ("announce", "introducing", "new"),
    "Transactional": ("order", "receipt", "payment"),
    "Awareness": ("learn", "discover", "about"),
}
OTHERS = "Others"


def parse_records(df: DataFrame, json: str, file_name: str) -> DataFrame:
    """JSON replies to 19 typed fields: defaults, file name, upper case.

    A missing key, a value of the wrong type and malformed JSON all give the
    field's default.
    """
    raw = T.StructType([T.StructField(n, T.StringType()) for n, _, _ in RECORD_FIELDS])
    rows = df.select(
        *[c for c in df.columns if c not in (json, file_name)],
        F.col(file_name).alias("__file"),
        F.from_json(F.col(json), raw).alias("r"),
    )
    typed = {
        n: F.coalesce(F.col(f"r.{n}").try_cast(t), F.lit(default).cast(t)) for n, t, default in RECORD_FIELDS
    }
    typed["file_name"] = strip_suffix(F.col("__file"), ".png")
    return upper_fields(rows.withColumns(typed).drop("__file", "r"), UPPER_FIELDS)


def closed_label(lowered: Column, labels: dict[str, tuple[str, ...]]) -> Column:
    """The first label one of whose words occurs in the lower-case text, else 'Others'."""
    return first_match([(any_of(lowered.contains(w) for w in words), label) for label, words in labels.items()], OTHERS)


def text_features(df: DataFrame, text: str) -> DataFrame:
    """Subject, lengths, offer, call to action and labels from a message's text.

    The first line is the subject and the rest the body. Words are looked up in
    one lower-case copy of the text; only the two offer amounts need patterns.
    """
    rest = [c for c in df.columns if c != text]
    whole, lowered = F.col(text), F.col("__lowered")
    subject = F.substring_index(whole, "\n", 1)
    found = df.select(
        *rest,
        F.lower(whole).alias("__lowered"),
        F.length(subject).alias("subject_length"),
        F.greatest(F.length(whole) - F.length(subject) - 1, F.lit(0)).alias("body_length"),
        F.regexp_extract(whole, "([0-9]+)\\s?%", 1).alias("__percent"),
        F.regexp_extract(whole, "[$]\\s?([0-9]+)", 1).alias("__amount"),
    )
    percent, amount = F.col("__percent"), F.col("__amount")
    priced = (percent != "") | (amount != "")
    free = lowered.contains("free")
    return found.select(
        *rest,
        "subject_length",
        "body_length",
        (priced | free).alias("offer_flag"),
        F.when(priced, "Discount Offer").when(free, "Free Item Offer").otherwise("No Offer").alias("offer_type"),
        F.when(percent != "", F.concat(percent, F.lit("%")))
        .when(amount != "", F.concat(F.lit("$"), amount))
        .otherwise("0")
        .alias("offer_value"),
        lowered.contains("order now").alias("cta_order_now"),
        lowered.contains("visit").alias("cta_visit_restaurant"),
        closed_label(lowered, EMAIL_TONES).alias("email_tone"),
        closed_label(lowered, EMAIL_TYPES).alias("email_type"),
        closed_label(lowered, BODY_TONES).alias("body_tone"),
        closed_label(lowered, BODY_TYPES).alias("body_type"),
    )
