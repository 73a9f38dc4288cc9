"""Queries of creative records, text features, listings and search requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.catalog.proxies import Inputs, twin
from wayfold.catalog.registry import query
from wayfold.functions.rules import sql_case
from wayfold.plans import creative, listings

LABEL_SETS = (
    ("email_tone", creative.EMAIL_TONES),
    ("email_type", creative.EMAIL_TYPES),
    ("body_tone", creative.BODY_TONES),
    ("body_type", creative.BODY_TYPES),
)


@query("creative_record_parse", """SELECT conv_id, turn, concat('mail_', conv_id, '_', turn) AS file_name,
    CASE WHEN bad THEN '' ELSE upper(role) END AS subject, CASE WHEN bad THEN 0 ELSE CAST(length(role) AS INT) END AS subject_length,
    CASE WHEN bad OR turn % 2 = 1 THEN '' ELSE 'PROMOTIONAL' END AS email_tone, '' AS email_type, '' AS body_tone,
    CASE WHEN bad THEN '' ELSE 'REMINDER' END AS body_type,
    CASE WHEN bad OR turn % 3 = 0 THEN 0 ELSE CAST(length(text) AS INT) END AS body_length,
    CASE WHEN bad THEN '' ELSE text END AS campaign_body,
    CASE WHEN bad OR turn % 2 = 1 THEN FALSE ELSE contains(text, 'the') END AS offer_flag,
    '' AS offer_type, '' AS offer, CASE WHEN bad THEN '0' ELSE CAST(turn AS STRING) END AS offer_value,
    CASE WHEN bad THEN FALSE ELSE role = 'user' END AS cta_order_now, FALSE AS cta_visit_restaurant,
    FALSE AS image_flag, '' AS image, '' AS image_item, FALSE AS color_theme
    FROM (SELECT *, conv_id % 10 = 9 AS bad FROM conversations) c""")
def creative_record_parse(t: Inputs) -> DataFrame:
    even = F.col("turn") % 2 == 0
    reply = F.to_json(
        F.struct(
            F.col("role").alias("subject"),
            F.length("role").alias("subject_length"),
            F.when(even, "Promotional").alias("email_tone"),
            F.lit("Reminder").alias("body_type"),
            # The wrong type for a length: the default must come out.
            F.when(F.col("turn") % 3 == 0, "unknown").otherwise(F.length("text").cast("string")).alias("body_length"),
            F.col("text").alias("campaign_body"),
            F.when(even, F.col("text").contains("the")).alias("offer_flag"),
            F.col("turn").alias("offer_value"),
            (F.col("role") == "user").alias("cta_order_now"),
        )
    )
    replies = t.conversations.select(
        "conv_id",
        "turn",
        F.when(F.col("conv_id") % 10 == 9, F.concat(F.lit("no json: "), reply)).otherwise(reply).alias("reply"),
        F.concat(F.lit("mail_"), F.col("conv_id"), F.lit("_"), F.col("turn"), F.lit(".png")).alias("path"),
    )
    return creative.parse_records(replies, "reply", "path")


def _label_sql(labels: dict[str, tuple[str, ...]]) -> str:
    arms = [(" OR ".join(f"contains(low, '{w}')" for w in words), f"'{label}'") for label, words in labels.items()]
    return sql_case(arms, "'Others'")


@query("creative_text_features", f"""SELECT doc_id, CAST(length(split_part(text, chr(10), 1)) AS INT) AS subject_length,
    CAST(length(substr(text, length(split_part(text, chr(10), 1)) + 2)) AS INT) AS body_length,
    pct <> '' OR amt <> '' OR contains(low, 'free') AS offer_flag,
    CASE WHEN pct <> '' OR amt <> '' THEN 'Discount Offer' WHEN contains(low, 'free') THEN 'Free Item Offer'
        ELSE 'No Offer' END AS offer_type,
    CASE WHEN pct <> '' THEN concat(pct, '%') WHEN amt <> '' THEN concat('$', amt) ELSE '0' END AS offer_value,
    contains(low, 'order now') AS cta_order_now, contains(low, 'visit') AS cta_visit_restaurant,
    {", ".join(f"{_label_sql(labels)} AS {name}" for name, labels in LABEL_SETS)}
    FROM (SELECT *, regexp_extract(text, '([0-9]+)\\s?%', 1) AS pct, regexp_extract(text, '[$]\\s?([0-9]+)', 1) AS amt,
        lower(text) AS low FROM documents) d""")
def creative_text_features(t: Inputs) -> DataFrame:
    return creative.text_features(t.documents.select("doc_id", "text"), "text")


_BLOCK = "(?s)<li>.*?</li>"
_FIELDS = [
    listings.PageField("name", "<a [^>]*>([^<]*)</a>", listings.LISTING_DEFAULTS["name"]),
    listings.PageField("address", "(?s)<h1[^>]*>([^<]*)</h1>", listings.LISTING_DEFAULTS["address"], from_page=True),
    listings.PageField("rating", 'lang="([^"]*)"', listings.LISTING_DEFAULTS["rating"], "first_token", True),
    listings.PageField("review_count", 'href="/[^"]*?([0-9]+)', listings.LISTING_DEFAULTS["review_count"]),
    listings.PageField("feedback", "(?s)<p>([^<]*)", listings.LISTING_DEFAULTS["feedback"], "before_dots", True),
]


def _field_sql(source: str, pattern: str, default: str, how: str = "text") -> str:
    found = f"trim(regexp_extract({source}, '{pattern}', 1))"
    if how == "first_token":
        found = f"split_part({found}, ' ', 1)"
    elif how == "before_dots":
        found = f"split_part({found}, '...', 1)"
    return f"coalesce(nullif(trim({found}), ''), '{default}')"


@query("listing_extract_flat", f"""SELECT page_id, url, CAST(position - 1 AS INT) AS position,
    {_field_sql("block", "<a [^>]*>([^<]*)</a>", "Null")} AS name,
    {_field_sql("html", "(?s)<h1[^>]*>([^<]*)</h1>", "Unknown")} AS address,
    {_field_sql("html", 'lang="([^"]*)"', "0", "first_token")} AS rating,
    {_field_sql("block", 'href="/[^"]*?([0-9]+)', "0")} AS review_count,
    {_field_sql("html", "(?s)<p>([^<]*)", "None", "before_dots")} AS feedback
    FROM (SELECT page_id, url, html, unnest(regexp_extract_all(html, '{_BLOCK}')) AS block,
        generate_subscripts(regexp_extract_all(html, '{_BLOCK}'), 1) AS position FROM pages) p""")
def listing_extract_flat(t: Inputs) -> DataFrame:
    return listings.extract_listings(t.pages.select("page_id", "url", "html"), "html", _BLOCK, _FIELDS)


# Result pages of at most 100 suppliers of a nation. A card holds boxes of its own element and, for some suppliers, a
# second card; every field is missing in some cards.
_CARD_FIELDS = [
    listings.PageField("name", '<a class="name">([^<]*)</a>', listings.LISTING_DEFAULTS["name"]),
    listings.PageField("address", '<span class="address">([^<]*)</span>', listings.LISTING_DEFAULTS["address"]),
    listings.PageField("rating", '<div class="stars" aria-label="([^"]*)"', listings.LISTING_DEFAULTS["rating"], "first_token"),
    listings.PageField("review_count", '<span class="count">([^<]*)</span>', listings.LISTING_DEFAULTS["review_count"]),
    listings.PageField("feedback", "<p>([^<]*)</p>", listings.LISTING_DEFAULTS["feedback"], "before_dots"),
]


def result_pages(t: Inputs) -> DataFrame:
    """(location, page, html): stored result pages of the suppliers."""
    key = F.col("s_suppkey")
    unless = lambda n, *parts: F.when(key % n != 0, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))
    card = F.concat_ws(
        "",
        F.lit('<div class="card"><div class="box">'),
        unless(5, '<a class="name">', F.col("s_name"), "</a>"),
        unless(3, '<div class="stars" aria-label="', (key % 5 + 1).cast("string"), '.5 star rating"></div>'),
        F.lit("</div><div>"),
        unless(4, '<span class="address"> ', F.col("n_name"), " ", key.cast("string"), "</span>"),
        unless(6, '<span class="count">', (key % 100).cast("string"), "</span>"),
        unless(7, "<p>Good ", F.col("s_name"), "...more</p>"),
        F.lit("</div>"),
        F.when(key % 8 == 0, '<div class="card"><a class="name">Annex</a></div>'),
        F.lit("</div>"),
    )
    cards = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    cards = cards.select(F.col("n_name").alias("location"), F.expr("s_suppkey div 100").alias("page"), "s_suppkey", card.alias("card"))
    ordered = F.array_sort(F.collect_list(F.struct("s_suppkey", "card")))
    return cards.groupBy("location", "page").agg(F.array_join(F.transform(ordered, lambda x: x["card"]), "").alias("html"))


@query("listing_extract", """SELECT location, page, CAST(row_number() OVER (PARTITION BY location, page ORDER BY s_suppkey, depth) - 1 AS INT)
        AS position, name, address, rating, review_count, feedback FROM (
    SELECT n_name AS location, s_suppkey // 100 AS page, s_suppkey, 0 AS depth,
        CASE WHEN s_suppkey % 5 <> 0 THEN s_name WHEN s_suppkey % 8 = 0 THEN 'Annex' ELSE 'Null' END AS name,
        CASE WHEN s_suppkey % 4 <> 0 THEN concat(n_name, ' ', s_suppkey) ELSE 'Unknown' END AS address,
        CASE WHEN s_suppkey % 3 <> 0 THEN concat(s_suppkey % 5 + 1, '.5') ELSE '0' END AS rating,
        CASE WHEN s_suppkey % 6 <> 0 THEN CAST(s_suppkey % 100 AS VARCHAR) ELSE '0' END AS review_count,
        CASE WHEN s_suppkey % 7 <> 0 THEN concat('Good ', s_name) ELSE 'None' END AS feedback
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT n_name, s_suppkey // 100, s_suppkey, 1, 'Annex', 'Unknown', '0', '0', 'None'
    FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 8 = 0) c""")
def listing_extract(t: Inputs) -> DataFrame:
    blocks = listings.nested_blocks(F.col("html"), "div", 'class="card"')
    return listings.extract_listings(result_pages(t), "html", blocks, _CARD_FIELDS)


@query("search_request_plan", twin("""SELECT zip, concat('https://listings.example/search?find_desc=Burrito%20Bar&find_loc=',
    CAST(zip AS STRING), '&start=0') AS url FROM (SELECT DISTINCT zip FROM conversion) z""", "conversion"))
def search_request_plan(t: Inputs) -> DataFrame:
    zips = t.conversion.select("zip").distinct()
    return listings.search_requests(
        zips, "zip", "https://listings.example", "/search", "listings", {"find_desc": "Burrito Bar"}
    )
