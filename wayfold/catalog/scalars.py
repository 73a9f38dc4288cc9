"""Queries of scalar functions and encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.catalog.journey import OPENS_SQL, SEND_KEY
from wayfold.catalog.proxies import Inputs, twin
from wayfold.catalog.registry import query, rounded
from wayfold.functions import dates, text
from wayfold.functions.rules import map_values
from wayfold.operators.aggregates import event_rollup
from wayfold.operators.encode import DWELLING_UNITS, YES_NO, fit_levels, number_levels, one_hot_drop_first, one_hot_sparse, ordinal_join
from wayfold.operators.outliers import bounds_as_dict, clip_to_bounds
from wayfold.operators.quantiles import bounds
from wayfold.operators.sampling import split_fraction
from wayfold.storage import cut

ORDER_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("hour_diff_boundary", twin("""SELECT s.subscriberid, s.sendid, s.eventdate, o.first_open_timestamp,
    CAST(date_diff('hour', s.eventdate, o.first_open_timestamp) AS INT) AS hours
    FROM sent s LEFT JOIN o ON s.subscriberid = o.subscriberid AND s.sendid = o.sendid""", "sent", "opens", o=OPENS_SQL))
def hour_diff_boundary(t: Inputs) -> DataFrame:
    opens = event_rollup(t.opens, SEND_KEY, "eventdate", ("n", "first_open_timestamp", "last"))
    both = t.sent.join(opens.drop("subscriberkey", "n", "last"), ["subscriberid", "sendid"], "left")
    return both.select(
        "subscriberid",
        "sendid",
        "eventdate",
        "first_open_timestamp",
        dates.hours_crossed(F.col("eventdate"), F.col("first_open_timestamp")).alias("hours"),
    )


@query("day_diff", """SELECT l_orderkey, l_partkey, l_shipdate,
    CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INT) AS days
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def day_diff(t: Inputs) -> DataFrame:
    both = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    days = dates.days_between(F.col("o_orderdate"), F.col("l_shipdate"))
    return both.select("l_orderkey", "l_partkey", "l_shipdate", days.alias("days"))


@query("date_shift", """SELECT o_orderkey, CAST(o_orderdate AS DATE) + 90 AS later,
    CAST(o_orderdate AS DATE) - 2 AS earlier FROM orders""")
def date_shift(t: Inputs) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey", dates.shift_days(day, 90).alias("later"), dates.shift_days(day, -2).alias("earlier")
    )


@query("week_ending_sunday", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day,
    CAST(o_orderdate AS DATE) + (7 - CAST(date_part('dow', o_orderdate) AS INT)) % 7 AS week_end FROM orders""")
def week_ending_sunday(t: Inputs) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", day.alias("day"), dates.week_ending_sunday(day).alias("week_end"))


@query("month_cohort", """SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS start_cohort,
    strftime(CAST(o_orderdate AS DATE) + 90, '%Y%m') AS end_cohort FROM orders""")
def month_cohort(t: Inputs) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey",
        dates.month_cohort(day).alias("start_cohort"),
        dates.month_cohort(dates.shift_days(day, 90)).alias("end_cohort"),
    )


@query("substring_concat", """SELECT o_orderkey, substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4)
    || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2) AS cohort FROM orders""")
def substring_concat(t: Inputs) -> DataFrame:
    day = F.col("o_orderdate").cast("date").cast("string")
    return t.orders.select("o_orderkey", F.concat(F.substring(day, 1, 4), F.substring(day, 6, 2)).alias("cohort"))


@query("first_last_char", twin("""SELECT opportunityid, buying_power_score,
    TRY_CAST(substr(buying_power_score, 1, 1) AS DOUBLE) AS disposable_part,
    right(buying_power_score, 1) AS ability_part FROM conversion""", "conversion"))
def first_last_char(t: Inputs) -> DataFrame:
    code = F.col("buying_power_score")
    return t.conversion.select(
        "opportunityid",
        "buying_power_score",
        text.first_char(code).try_cast("double").alias("disposable_part"),
        text.last_char(code).alias("ability_part"),
    )


@query("upper_fields", "SELECT p_partkey, upper(p_name) AS p_name, upper(p_brand) AS p_brand FROM part")
def upper_fields(t: Inputs) -> DataFrame:
    return text.upper_fields(t.part.select("p_partkey", "p_name", "p_brand"), ["p_name", "p_brand"])


@query("strip_suffix", """SELECT p_partkey, concat(p_name, CASE WHEN p_size % 2 = 0 THEN '' ELSE '.pngx' END) AS file_name
    FROM part""")
def strip_suffix(t: Inputs) -> DataFrame:
    name = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, ".png").otherwise(".pngx"))
    return t.part.select("p_partkey", text.strip_suffix(name, ".png").alias("file_name"))


@query("map_dict", twin("""SELECT opportunityid, CASE vacancy_indicator WHEN 'Y' THEN 1.0 WHEN 'N' THEN 0.0 END AS vacancy,
    CAST(CASE dwelling_unit_size WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'D' THEN 4 WHEN 'E' THEN 5
        WHEN 'F' THEN 10 WHEN 'G' THEN 20 WHEN 'H' THEN 50 WHEN 'I' THEN 101 END AS DOUBLE) AS units
    FROM conversion""", "conversion"))
def map_dict(t: Inputs) -> DataFrame:
    return t.conversion.select(
        "opportunityid",
        map_values(F.col("vacancy_indicator"), YES_NO).alias("vacancy"),
        map_values(F.col("dwelling_unit_size"), DWELLING_UNITS).alias("units"),
    )


@query("one_hot_drop_first", twin(
    "SELECT opportunityid, "
    + ", ".join(f"CASE WHEN response_channel = '{v}' THEN 1.0 ELSE 0.0 END AS \"response_channel_{v}\""
                for v in ORDER_PRIORITIES[1:])
    + ", " + ", ".join(f"CASE WHEN dwelling_type = '{v}' THEN 1.0 ELSE 0.0 END AS \"dwelling_type_{v}\""
                       for v in ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
    + " FROM conversion", "conversion"))
def one_hot(t: Inputs) -> DataFrame:
    rows = t.conversion.select("opportunityid", "response_channel", "dwelling_type")
    return one_hot_drop_first(rows, fit_levels(rows, ["response_channel", "dwelling_type"]))


@query("ordinal_encode", twin("""SELECT opportunityid, dwelling_type, CAST(d.i AS DOUBLE) AS dwelling_type_idx
    FROM conversion c LEFT JOIN (SELECT dwelling_type AS v, row_number() OVER (ORDER BY dwelling_type) - 1 AS i
        FROM (SELECT DISTINCT dwelling_type FROM conversion WHERE dwelling_type IS NOT NULL) x) d
    ON c.dwelling_type = d.v""", "conversion"))
def ordinal(t: Inputs) -> DataFrame:
    rows = t.conversion.select("opportunityid", "dwelling_type")
    return ordinal_join(rows, {"dwelling_type": number_levels(rows, "dwelling_type")})


@query("one_hot_sparse", twin("""SELECT opportunityid, CAST(greatest((SELECT count(DISTINCT l) FROM named) - 1, 0) AS INT) AS size,
    CAST(CASE WHEN d.i > 0 THEN d.i - 1 END AS INT) AS at, CASE WHEN d.i > 0 THEN 1.0E0 END AS value
    FROM named LEFT JOIN (SELECT l AS v, row_number() OVER (ORDER BY l) - 1 AS i FROM (SELECT DISTINCT l FROM named
        WHERE l IS NOT NULL) x) d ON l = d.v""", "conversion",
    named="SELECT opportunityid, concat(dwelling_type, '/', market, '/', CAST(zip AS STRING)) AS l FROM conversion "
    "WHERE dwelling_type IS NOT NULL"))
def one_hot_of_many(t: Inputs) -> DataFrame:
    level = F.concat("dwelling_type", F.lit("/"), "market", F.lit("/"), F.col("zip").cast("string"))
    rows = cut(t.conversion.where("dwelling_type IS NOT NULL").select("opportunityid", level.alias("level")), "named")
    hot = F.col("level_hot")
    return one_hot_sparse(rows, {"level": number_levels(rows, "level")}).select(
        "opportunityid", hot["size"].alias("size"), F.get(hot["indices"], 0).alias("at"), F.get(hot["values"], 0).alias("value")
    )


_TRAIN = "substr(md5(concat('2', opportunityid)), 1, 8) < 'cccccccc'"


@query("winsorize_fit_apply", twin(f"""SELECT opportunityid,
    round(CASE WHEN balance IS NOT NULL THEN greatest(b.lo, least(b.hi, balance)) END, 4) AS balance,
    round(greatest(h.lo, least(h.hi, home_value)), 4) AS home_value
    FROM conversion, (SELECT quantile_cont(balance, 0.05) AS lo, quantile_cont(balance, 0.95) AS hi FROM conversion
        WHERE {_TRAIN}) b, (SELECT quantile_cont(home_value, 0.05) AS lo, quantile_cont(home_value, 0.95) AS hi
        FROM conversion WHERE {_TRAIN}) h""", "conversion"))
def winsorize(t: Inputs) -> DataFrame:
    rows = t.stored("conversion", "opportunityid", "balance", "home_value")
    train, _ = split_fraction(rows, "opportunityid", 0.8, "2")
    return rounded(clip_to_bounds(rows, bounds_as_dict(bounds(train, ["balance", "home_value"]))))


@query("parse_timestamp", """SELECT o_orderkey, o_orderdate AS stamp, CAST(o_orderdate AS DATE) AS day,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS checked_day FROM orders""")
def parse_timestamp(t: Inputs) -> DataFrame:
    written = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    spoiled = F.when(F.col("o_orderkey") % 5 == 0, "not a date").otherwise(written)
    return t.orders.select(
        "o_orderkey",
        F.to_timestamp_ntz(written, F.lit("yyyy-MM-dd HH:mm:ss")).alias("stamp"),
        written.cast("date").alias("day"),
        spoiled.try_cast("date").alias("checked_day"),
    )


@query("first_token", """SELECT s_suppkey, split_part(trim(s_name), '#', 1) AS kind,
    split_part(trim(concat('  ', s_name, ' rating')), ' ', 1) AS token,
    split_part(trim(concat(s_name, '...more')), '...', 1) AS feedback FROM supplier""")
def first_token(t: Inputs) -> DataFrame:
    name = F.col("s_name")
    return t.supplier.select(
        "s_suppkey",
        text.before_marker(name, "#").alias("kind"),
        text.first_token(F.concat(F.lit("  "), name, F.lit(" rating"))).alias("token"),
        text.before_marker(F.concat(name, F.lit("...more")), "...").alias("feedback"),
    )
