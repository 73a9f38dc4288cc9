"""Queries of grouped counts, rates, pivots, profiles and correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.catalog.proxies import MONTHS, Inputs, twin
from wayfold.catalog.registry import query, rounded
from wayfold.operators import aggregates, frames
from wayfold.operators.correlation import corr_matrix, corr_with_target
from wayfold.operators.joins import dimension_default
from wayfold.operators.sampling import split_fraction
from wayfold.operators.quantiles import bounds, long_values, medians_by, modes_of_counts, value_counts_by

FEATURES = ("size_score", "balance", "discount", "quantity", "tax", "home_value", "mostly_missing_a", "score")
ALL_YEARS = tuple(range(1995, 2002))


def conversion_twin(body: str, **views: str) -> str:
    """A twin over the conversion proxy."""
    return twin(body, "conversion", **views)


@query("count_distinct", twin("""SELECT subscriberid, count(DISTINCT sendid) AS sends,
    count(DISTINCT CAST(eventdate AS DATE)) AS days FROM sent GROUP BY 1""", "sent"))
def count_distinct(t: Inputs) -> DataFrame:
    return t.sent.groupBy("subscriberid").agg(
        F.count_distinct("sendid").alias("sends"), F.count_distinct(F.col("eventdate").cast("date")).alias("days")
    )


@query("group_size", conversion_twin("""SELECT dwelling_type, won, count(*) AS n FROM conversion
    WHERE dwelling_type IS NOT NULL AND won IS NOT NULL GROUP BY 1, 2"""))
def group_size(t: Inputs) -> DataFrame:
    return aggregates.group_size(t.conversion, ["dwelling_type", "won"])


@query("value_counts", conversion_twin("SELECT response_channel, count(*) AS n FROM conversion GROUP BY 1"))
def value_counts(t: Inputs) -> DataFrame:
    return aggregates.value_counts(t.conversion, "response_channel")


@query("filtered_group_sum", conversion_twin("""SELECT fiscalmonth, CAST(sum(won) AS BIGINT) AS won FROM conversion
    WHERE fiscalyear = 1997 GROUP BY 1"""))
def filtered_group_sum(t: Inputs) -> DataFrame:
    sums = t.conversion.where("fiscalyear = 1997").groupBy("fiscalmonth").agg(F.sum("won").alias("won"))
    return sums.orderBy(F.desc("won"), "fiscalmonth")


@query("ratio_of_sums", conversion_twin("""SELECT '1997' AS years, market, round(sum(won) / sum(opps), 4) AS conversion_rate
    FROM conversion WHERE fiscalyear = 1997 GROUP BY 2
    UNION ALL SELECT 'several', market, round(sum(won) / sum(opps), 4) FROM conversion
    WHERE fiscalyear IN (1996, 1997, 1998) GROUP BY 2"""))
def ratio_of_sums(t: Inputs) -> DataFrame:
    year = F.col("fiscalyear")
    one = aggregates.ratio_of_sums(t.conversion.where(year == 1997), "market", "won", "opps", "conversion_rate")
    several = t.conversion.where(year.isin(1996, 1997, 1998))
    more = aggregates.ratio_of_sums(several, "market", "won", "opps", "conversion_rate")
    return rounded(
        one.withColumn("years", F.lit("1997")).unionByName(more.withColumn("years", F.lit("several")))
    )


@query("share_of_total", conversion_twin("""SELECT won, dwelling_unit_size, count(*) AS n,
    round(count(*) * 100.0 / (SELECT count(*) FROM conversion), 4) AS percentage FROM conversion GROUP BY 1, 2"""))
def share_of_total(t: Inputs) -> DataFrame:
    return rounded(aggregates.share_of_total(t.conversion, ["won", "dwelling_unit_size"]))


@query("mean_by_key", conversion_twin("SELECT zip, round(avg(won_amount), 4) AS mean FROM conversion GROUP BY 1"))
def mean_by_key(t: Inputs) -> DataFrame:
    return rounded(t.conversion.groupBy("zip").agg(F.avg("won_amount").alias("mean")))


_MEDIANS = ("size_score", "balance", "discount", "quantity", "home_value")


@query("median_by_key", conversion_twin(
    "SELECT zip, " + ", ".join(f"round(median({c}), 4) AS {c}" for c in _MEDIANS) + " FROM conversion GROUP BY 1"))
def median_by_key(t: Inputs) -> DataFrame:
    return rounded(medians_by(t.stored("conversion", "zip", *_MEDIANS), ["zip"], list(_MEDIANS)))


@query("mode_by_key", conversion_twin("""SELECT zip, dwelling_type AS mode FROM (
    SELECT zip, dwelling_type, row_number() OVER (PARTITION BY zip ORDER BY count(*) DESC, dwelling_type) AS rn
    FROM conversion WHERE dwelling_type IS NOT NULL GROUP BY 1, 2) x WHERE rn = 1"""))
def mode_by_key(t: Inputs) -> DataFrame:
    counts = value_counts_by(long_values(t.conversion, ["zip"], ["dwelling_type"], "string"), ["zip"])
    return modes_of_counts(counts, ["zip"])


def _pivot_sql(row: str, column: str, values, source: str = "conversion", where: str = "") -> str:
    cells = ", ".join(
        f"nullif(count(CASE WHEN {column} = {repr(v)} THEN 1 END), 0) AS \"{v}\"" for v in values
    )
    return f"SELECT {row}, {cells} FROM {source} WHERE won = 1 {where} GROUP BY {row}"


@query("pivot_month_by_year", conversion_twin(_pivot_sql("fiscalmonth", "fiscalyear", ALL_YEARS)))
def pivot_month_by_year(t: Inputs) -> DataFrame:
    table = aggregates.pivot_count(t.conversion.where("won = 1"), "fiscalmonth", "fiscalyear")
    return table.orderBy(aggregates.in_given_order(F.col("fiscalmonth"), MONTHS))


@query("pivot_week_by_year", conversion_twin(
    _pivot_sql("fiscalweek", "fiscalyear", ALL_YEARS, where="AND fiscalweek BETWEEN 1 AND 52")))
def pivot_week_by_year(t: Inputs) -> DataFrame:
    won = t.conversion.where("won = 1 AND fiscalweek BETWEEN 1 AND 52")
    return aggregates.pivot_count(won, "fiscalweek", "fiscalyear").orderBy("fiscalweek")


_REGIONS = ("AFRICA", "AMERICA", "EUROPE", "MIDDLE EAST", "Others")
_WITH_REGION = """SELECT c.*, coalesce(region, 'Others') AS region FROM conversion c LEFT JOIN branches ON market = branch"""


def _with_region(t: Inputs) -> DataFrame:
    rows = t.conversion.where("won = 1").select("market", "fiscalyear", "fiscalweek")
    return dimension_default(rows, t.branches, "market", "branch", "region", "Others")


@query("pivot_year_by_region", twin(_pivot_sql("fiscalyear", "region", _REGIONS, "r"), "conversion", "branches",
                                    r=_WITH_REGION))
def pivot_year_by_region(t: Inputs) -> DataFrame:
    return aggregates.pivot_count(_with_region(t), "fiscalyear", "region").orderBy("fiscalyear")


@query("pivot_week_by_region", twin(
    _pivot_sql("fiscalweek", "region", _REGIONS, "r", "AND fiscalweek BETWEEN 1 AND 52"), "conversion", "branches",
    r=_WITH_REGION))
def pivot_week_by_region(t: Inputs) -> DataFrame:
    weeks = _with_region(t).where("fiscalweek BETWEEN 1 AND 52")
    return aggregates.pivot_count(weeks, "fiscalweek", "region").orderBy("fiscalweek")


_PROFILED = (*FEATURES, "won_amount", "mostly_missing_b", "dwelling_type", "buying_power_score", "market")
_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 4) AS null_pct FROM conversion"
    for c in _PROFILED
)


@query("null_profile", conversion_twin(_PROFILE_SQL))
def null_profile(t: Inputs) -> DataFrame:
    return rounded(frames.null_profile(t.conversion.select(*_PROFILED)))


@query("drop_sparse_columns", conversion_twin("""SELECT opportunityid, balance, discount, dwelling_type
    FROM conversion"""))
def drop_sparse_columns(t: Inputs) -> DataFrame:
    chosen = ["opportunityid", "balance", "discount", "dwelling_type", "won_amount", "mostly_missing_a"]
    return frames.drop_sparse_columns(t.conversion.select(*chosen, "mostly_missing_b"))


@query("unique_values", conversion_twin("SELECT DISTINCT buying_power_score FROM conversion"))
def unique_values(t: Inputs) -> DataFrame:
    return t.conversion.select("buying_power_score").distinct()


@query("count_unique", conversion_twin("""SELECT count(DISTINCT opportunityid) AS ids, count(DISTINCT zip) AS zips,
    count(DISTINCT CASE WHEN balance IS NULL THEN zip END) AS zips_without_balance FROM conversion"""))
def count_unique(t: Inputs) -> DataFrame:
    return t.conversion.agg(
        F.count_distinct("opportunityid").alias("ids"),
        F.count_distinct("zip").alias("zips"),
        F.count_distinct(F.when(F.col("balance").isNull(), F.col("zip"))).alias("zips_without_balance"),
    )


@query("min_max", conversion_twin("SELECT min(creationdate) AS first_day, max(creationdate) AS last_day FROM conversion"))
def min_max(t: Inputs) -> DataFrame:
    return t.conversion.agg(F.min("creationdate").alias("first_day"), F.max("creationdate").alias("last_day"))


@query("percentile_bounds", conversion_twin(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(quantile_cont({c}, 0.05), 4) AS lo, round(quantile_cont({c}, 0.95), 4) AS hi "
    "FROM conversion" for c in FEATURES)))
def percentile_bounds(t: Inputs) -> DataFrame:
    return rounded(bounds(t.stored("conversion", *FEATURES), list(FEATURES)))


@query("corr_with_target", conversion_twin(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, won), 4) AS r FROM conversion" for c in FEATURES)))
def corr_with_target_query(t: Inputs) -> DataFrame:
    return rounded(corr_with_target(t.conversion, list(FEATURES), "won"))


@query("corr_matrix", conversion_twin(" UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 4) AS r FROM conversion"
    for a, b in combinations([*FEATURES, "won"], 2))))
def corr_matrix_query(t: Inputs) -> DataFrame:
    return rounded(corr_matrix(t.stored("conversion", *FEATURES, "won"), [*FEATURES, "won"]))


@query("segment_lift", conversion_twin("""SELECT part, coalesce(waterfront_home = 1, FALSE) AS in_segment,
    count(*) AS rows, CAST(sum(won) AS BIGINT) AS positives, round(avg(won), 4) AS positive_rate
    FROM (SELECT *, CASE WHEN substr(md5(concat('2', opportunityid)), 1, 8) < 'cccccccc' THEN 'train' ELSE 'test' END
        AS part FROM conversion) c GROUP BY 1, 2"""))
def segment_lift(t: Inputs) -> DataFrame:


    rows = t.conversion.select("opportunityid", "waterfront_home", "won")
    train, test = split_fraction(rows, "opportunityid", 0.8, "2")
    parts = [
        aggregates.segment_lift(frame, "waterfront_home", "won").withColumn("part", F.lit(name))
        for name, frame in (("train", train), ("test", test))
    ]
    return rounded(frames.stack_frames(parts))
