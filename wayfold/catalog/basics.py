"""Queries of sources, sinks, projections and filters."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.catalog.journey import TOUCH_CASE, text, variant_sql
from wayfold.catalog.proxies import Inputs, twin
from wayfold.catalog.registry import query, rounded
from wayfold.functions.rules import classify_like, flag, map_values
from wayfold.operators import frames
from wayfold.operators.quantiles import bounds, medians_by
from wayfold.plans import journey, offers, touches
from wayfold.sources.delimited import read_delimited, write_delimited
from wayfold.sources.fitted import load_fitted_tables, save_fitted_tables
from wayfold.sources.images import scan_image_parts, write_images
from wayfold.sources.tables import publish_copy, replace_table_as, scan, write_clustered
from wayfold.storage import cut, scratch_path


def _work_name(t: Inputs, name: str) -> str:
    """A table name of its own per input folder."""
    return f"wf_{zlib.crc32(t.folder.encode()):08x}_{name}"


# --- sources ---------------------------------------------------------------


@query("scan_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_table(t: Inputs) -> DataFrame:
    name = _work_name(t, "orders")
    t.spark.sql(f"DROP TABLE IF EXISTS {name}")
    t.spark.catalog.createTable(name, path=f"{t.folder}/orders.parquet", source="parquet")
    return scan(t.spark, t.spark.catalog.currentDatabase(), name).select("o_orderkey", "o_custkey", "o_totalprice")


@query("read_delimited", "SELECT * FROM orders")
def read_delimited_query(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "orders-text")
    write_delimited(t.orders, path)
    return read_delimited(t.spark, path, t.orders.schema)


@query("read_delimited_large", """SELECT l_returnflag, l_linestatus, count(*) AS n,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1, 2""")
def read_delimited_large(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "lineitem-text")
    write_delimited(t.lineitem, path)
    rows = read_delimited(t.spark, path, t.lineitem.schema)
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents")
    )


@query("read_dimension", twin("SELECT c_custkey, region FROM customer JOIN nation ON c_nationkey = n_nationkey "
                              "JOIN branches ON n_name = branch", "branches"))
def read_dimension(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "branches")
    write_delimited(t.branches, path, ",")
    lookup = read_delimited(t.spark, path, T.StructType.fromDDL("branch string, region string"), ",")
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.join(lookup, F.col("n_name") == F.col("branch")).select("c_custkey", "region")


# A one-row grey image stored without compression: 8 bytes of signature, 25 of header, 12 around the data, 2 + 5 + 4 around the
# stored block, one byte before the row, 12 of the end chunk.
_IMAGE_FRAME = 8 + 25 + 12 + 2 + 5 + 4 + 1 + 12
_PIXELS_AT = 8 + 25 + 8 + 2 + 5 + 1 + 1


@query("scan_images", f"""SELECT printf('supplier-%08d.png', s_suppkey) AS file_name, strlen(s_name) + {_IMAGE_FRAME} AS n_bytes,
    strlen(s_name) AS width, CAST(1 AS BIGINT) AS height, TRUE AS intact,
    CAST((strlen(s_name) + {_IMAGE_FRAME} + 2) // 3 * 4 AS BIGINT) AS payload_length,
    to_base64(encode(s_name)) AS pixels FROM supplier WHERE s_name <> ''""")
def scan_images_query(t: Inputs) -> DataFrame:
    folder = scratch_path(t.spark, "images")
    drawn = t.supplier.where("s_name <> ''").select(
        F.format_string("supplier-%08d.png", "s_suppkey").alias("file_name"), F.encode("s_name", "UTF-8").alias("pixels")
    )
    cut(write_images(drawn, folder), "drawn")
    parts = scan_image_parts(t.spark, folder, part_bytes=30)
    whole = parts.groupBy("file_name", "n_bytes", "width", "height", "intact").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "payload"))), lambda p: p["payload"]), "").alias("payload")
    )
    pixels = F.substring(F.unbase64("payload"), F.lit(_PIXELS_AT), F.col("width").cast("int"))
    return whole.select(
        "file_name", "n_bytes", "width", "height", "intact", F.length("payload").cast("long").alias("payload_length"),
        F.regexp_replace(F.base64(pixels), "\\s", "").alias("pixels"),
    )


@query("load_fitted_tables", twin("""
    SELECT 'zip' AS kind, CAST(zip AS STRING) AS key, round(median(balance), 4) AS a, round(median(home_value), 4) AS b
    FROM conversion GROUP BY zip
    UNION ALL SELECT 'bounds', 'balance', round(quantile_cont(balance, 0.05), 4), round(quantile_cont(balance, 0.95), 4)
    FROM conversion""", "conversion"))
def load_fitted_tables_query(t: Inputs) -> DataFrame:
    folder = scratch_path(t.spark, "fitted")
    rows = t.stored("conversion", "zip", "balance", "home_value")
    save_fitted_tables(
        {"zips": medians_by(rows, ["zip"], ["balance", "home_value"]), "bounds": bounds(rows, ["balance"])}, folder
    )
    saved = load_fitted_tables(t.spark, folder, ["zips", "bounds"])
    zips = saved["zips"].select(
        F.lit("zip").alias("kind"), F.col("zip").cast("string").alias("key"), F.col("balance").alias("a"),
        F.col("home_value").alias("b"),
    )
    limits = saved["bounds"].select(
        F.lit("bounds").alias("kind"), F.col("column_name").alias("key"), F.col("lo").alias("a"), F.col("hi").alias("b")
    )
    return rounded(zips.unionByName(limits))


@query("normalize_types", """SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name,
    CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal,
    CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer""")
def normalize_types(t: Inputs) -> DataFrame:
    marked = t.customer.withColumn(
        "c_mktsegment", F.when(F.col("c_custkey") % 9 == 0, "nan").otherwise(F.col("c_mktsegment"))
    )
    return frames.normalize_types(marked)


# --- sinks -----------------------------------------------------------------


# Values that a separated file can lose: separators, line breaks, quotes, blanks, empty text and null.
_NOTES = ("a|b", "two\nlines", 'a "quote"', "  blanks  ", "", None, '"', "\\|\r\n")


@query("write_delimited", """SELECT c.*, note FROM customer c JOIN (VALUES (0, 'a|b'), (1, 'two' || chr(10) || 'lines'),
    (2, 'a "quote"'), (3, '  blanks  '), (4, ''), (5, NULL), (6, '"'), (7, chr(92) || '|' || chr(13) || chr(10))) AS n(k, note)
    ON c_custkey % 8 = k""")
def write_delimited_query(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "customer-text")
    note = F.get(F.array(*[F.lit(v) for v in _NOTES]), (F.col("c_custkey") % 8).cast("int"))
    rows = t.customer.withColumn("note", note)
    write_delimited(rows, path, "|")
    return read_delimited(t.spark, path, rows.schema, "|", quoted=True)


@query("replace_table_as", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 100000")
def replace_table(t: Inputs) -> DataFrame:
    rows = t.orders.where("o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_orderstatus")
    return replace_table_as(rows, _work_name(t, "large_orders"), scratch_path(t.spark, "large-orders"))


@query("write_clustered", "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last_order FROM orders GROUP BY 1")
def clustered(t: Inputs) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey")
    path = scratch_path(t.spark, "orders-by-customer")
    stored = write_clustered(rows, _work_name(t, "orders_by_customer"), ["o_custkey"], 8, path)
    return stored.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_order"))


@query("publish_copy", "SELECT s_suppkey, s_name FROM supplier")
def publish(t: Inputs) -> DataFrame:
    work = _work_name(t, "suppliers")
    replace_table_as(t.supplier.select("s_suppkey", "s_name"), work, scratch_path(t.spark, "suppliers"))
    return publish_copy(t.spark, work, f"{work}_report", scratch_path(t.spark, "suppliers-report"))


# --- projections -----------------------------------------------------------


@query("project_rename", """SELECT c_custkey AS loyaltymemberkey, c_name AS member_name, c_mktsegment AS cust_tag
    FROM customer""")
def project_rename(t: Inputs) -> DataFrame:
    names = {"c_custkey": "loyaltymemberkey", "c_name": "member_name", "c_mktsegment": "cust_tag"}
    return t.customer.select(*names).withColumnsRenamed(names)


@query("lateral_alias", """SELECT o_orderkey, round(o_totalprice * 0.9, 4) AS net,
    round(o_totalprice * 0.9 * 0.2, 4) AS duty,
    CASE WHEN o_totalprice * 0.9 > 100000 THEN 'large' ELSE 'small' END AS size FROM orders""")
def lateral_alias(t: Inputs) -> DataFrame:
    return rounded(
        t.spark.sql(
            """SELECT o_orderkey, o_totalprice * 0.9E0 AS net, net * 0.2E0 AS duty,
               CASE WHEN net > 100000 THEN 'large' ELSE 'small' END AS size FROM {orders}""",
            orders=t.orders,
        )
    )


@query("drop_columns", "SELECT l_orderkey, l_partkey, l_returnflag FROM lineitem")
def drop_columns(t: Inputs) -> DataFrame:
    keep = {"l_orderkey", "l_partkey", "l_returnflag"}
    rows = t.lineitem
    return rows.drop(*[c for c in rows.columns if c not in keep], "not_there")


@query("clean_column_names", "SELECT s_suppkey AS supplierkey, s_name AS suppliername FROM supplier")
def clean_column_names(t: Inputs) -> DataFrame:
    return frames.clean_column_names(
        t.supplier.select(F.col("s_suppkey").alias("supplier key"), F.col("s_name").alias(" supplier name"))
    )


@query("select_by_type", "SELECT c_nationkey, c_acctbal FROM customer")
def select_by_type(t: Inputs) -> DataFrame:
    return t.customer.select(*frames.columns_of_type(t.customer, True, ["c_custkey"]))


@query("filter_like", twin("""SELECT sendid, emailname FROM jobs
    WHERE emailname LIKE 'WJ%3.3_%' OR emailname LIKE 'WJ%_Nudge' OR emailname LIKE '%2.8%'""", "jobs"))
def filter_like(t: Inputs) -> DataFrame:
    name = F.col("emailname")
    return t.jobs.where(name.like("WJ%3.3_%") | name.like("WJ%_Nudge") | name.like("%2.8%")).select(
        "sendid", "emailname"
    )


@query("filter_like_nocase", twin("""SELECT sendid, emailname FROM jobs
    WHERE (upper(emailname) LIKE '%WJ%' OR (upper(emailname) LIKE '%NTJ%' AND emailname LIKE '%2.8%'))
    AND upper(emailname) NOT LIKE '%RWJ%'""", "jobs"))
def filter_like_nocase(t: Inputs) -> DataFrame:
    return t.jobs.where(touches.journey_job(F.col("emailname"))).select("sendid", "emailname")


@query("filter_in_list", twin(f"SELECT * FROM hard WHERE offercatalogcampaignkey IN ({text(offers.OFFER2_KEYS)})", "hard"))
def filter_in_list(t: Inputs) -> DataFrame:
    return t.hard.where(F.col("offercatalogcampaignkey").isin(*offers.OFFER2_KEYS))


@query("filter_not_in_3vl", twin("""SELECT checkkey, purchase_channel FROM transactions
    WHERE purchase_channel NOT IN ('MARKETPLACE')""", "transactions"))
def filter_not_in(t: Inputs) -> DataFrame:
    return t.transactions.where(~F.col("purchase_channel").isin(*journey.EXCLUDED_CHANNELS)).select(
        "checkkey", "purchase_channel"
    )


@query("filter_date_range", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
    WHERE o_orderdate BETWEEN DATE '1997-02-01' AND DATE '1997-03-31'""")
def filter_date_range(t: Inputs) -> DataFrame:
    day = F.col("o_orderdate")
    return t.orders.where(day.between("1997-02-01", "1997-03-31")).select("o_orderkey", day.cast("date").alias("day"))


@query("filter_not_null", twin("SELECT loyaltymemberkey, external_id FROM mapping WHERE loyaltymemberkey IS NOT NULL",
                               "mapping"))
def filter_not_null(t: Inputs) -> DataFrame:
    return t.mapping.where(F.col("loyaltymemberkey").isNotNull()).select("loyaltymemberkey", "external_id")


@query("filter_precedence_or", twin("""SELECT loyaltymemberkey, customerkey, created_date FROM mapping
    WHERE loyaltymemberkey IS NOT NULL AND created_date >= DATE '2020-11-14' AND ntj_entry_flag = 0
    OR wj_re_entry_date < ntj_entry_date""", "mapping"))
def filter_precedence_or(t: Inputs) -> DataFrame:
    return t.mapping.where(journey.in_this_journey()).select("loyaltymemberkey", "customerkey", "created_date")


@query("classify_first_match", twin(f"SELECT sendid, emailname, {TOUCH_CASE} AS touch_name FROM jobs", "jobs"))
def classify_first_match(t: Inputs) -> DataFrame:
    return t.jobs.select(
        "sendid", "emailname", classify_like(F.col("emailname"), touches.TOUCH_LABELS).alias("touch_name")
    )


@query("map_variant_by_name", twin(f"""SELECT sendid, emailname, {variant_sql(offers.OFFER2_VARIANTS)} AS offer2,
    {variant_sql(offers.OFFER3_VARIANTS)} AS offer3 FROM jobs""", "jobs"))
def map_variant_by_name(t: Inputs) -> DataFrame:
    name = F.col("emailname")
    return t.jobs.select(
        "sendid",
        "emailname",
        offers.variant_by_name(name, offers.OFFER2_VARIANTS).alias("offer2"),
        offers.variant_by_name(name, offers.OFFER3_VARIANTS).alias("offer3"),
    )


@query("map_code", twin("""SELECT checkkey, CASE WHEN purchase_channel = 'IN STORE' THEN 'INSTORE'
    WHEN purchase_channel IN ('WHITELABEL', 'ORDER AHEAD', 'CATERING') THEN 'DIGITAL' END AS medium,
    CASE purchase_channel WHEN 'IN STORE' THEN 1 WHEN 'WHITELABEL' THEN 2 END AS code FROM transactions""",
    "transactions"))
def map_code(t: Inputs) -> DataFrame:
    channel = F.col("purchase_channel")
    return t.transactions.select(
        "checkkey",
        journey.purchase_medium(channel).alias("medium"),
        map_values(channel, {"IN STORE": 1, "WHITELABEL": 2}).alias("code"),
    )


@query("flag_from_match", """SELECT c_custkey, CASE WHEN o_custkey IS NOT NULL THEN 1 ELSE 0 END AS has_orders,
    CASE WHEN o_custkey IS NOT NULL THEN 0 ELSE 1 END AS no_orders, 1 AS is_member
    FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON c_custkey = o_custkey""")
def flag_from_match(t: Inputs) -> DataFrame:
    buyers = t.orders.select("o_custkey").distinct()
    matched = F.col("o_custkey").isNotNull()
    return t.customer.join(buyers, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey",
        flag(matched).alias("has_orders"),
        (1 - flag(matched)).alias("no_orders"),
        F.lit(1).alias("is_member"),
    )


@query("coalesce_chain", twin("""SELECT customerkey, coalesce(journey_join_date, wj_re_entry_date, created_date) AS start
    FROM mapping""", "mapping"))
def coalesce_chain(t: Inputs) -> DataFrame:
    return t.mapping.select(
        "customerkey", F.coalesce("journey_join_date", "wj_re_entry_date", "created_date").alias("start")
    )


@query("fill_constant", twin("SELECT checkkey, coalesce(purchase_channel, 'Others') AS purchase_channel FROM transactions",
                             "transactions"))
def fill_constant(t: Inputs) -> DataFrame:
    return t.transactions.select("checkkey", "purchase_channel").fillna("Others", ["purchase_channel"])


@query("sentinel_to_null", """SELECT p_partkey, CASE WHEN p_size % 4 NOT IN (0, 1) THEN p_retailprice END AS price,
    CASE WHEN p_size % 3 <> 0 THEN p_type END AS p_type FROM part""")
def sentinel_to_null(t: Inputs) -> DataFrame:
    size = F.col("p_size")
    marked = t.part.select(
        "p_partkey",
        F.when(size % 4 == 0, F.lit(float("inf")))
        .when(size % 4 == 1, F.lit(float("nan")))
        .otherwise(F.col("p_retailprice"))
        .alias("price"),
        F.when(size % 3 == 0, "nan").otherwise(F.col("p_type")).alias("p_type"),
    )
    return frames.sentinels_to_null(marked)


@query("select_distinct", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def select_distinct(t: Inputs) -> DataFrame:
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("drop_rows_with_null", twin("""SELECT opportunityid, size_score, balance FROM conversion
    WHERE size_score IS NOT NULL AND balance IS NOT NULL""", "conversion"))
def drop_rows_with_null(t: Inputs) -> DataFrame:
    return t.conversion.select("opportunityid", "size_score", "balance").dropna(subset=["size_score", "balance"])
