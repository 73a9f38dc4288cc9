"""Queries of joins, sorts and set operations."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.catalog.journey import OPENS_SQL, UNSUBS_SQL, flags_sql
from wayfold.catalog.proxies import MONTHS, Inputs, twin
from wayfold.catalog.registry import query, rounded
from wayfold.operators import aggregates, frames, joins
from wayfold.operators.calendar import holidays_of, near_holiday_flag
from wayfold.operators.quantiles import medians_by
from wayfold.operators.sampling import split_fraction
from wayfold.plans import engagement
from wayfold.storage import cut



# --- joins -----------------------------------------------------------------


@query("join_inner", twin("""SELECT s.subscriberid, s.sendid, s.eventdate, j.emailname
    FROM sent s JOIN (SELECT * FROM jobs WHERE triggeredsendexternalkey IS NOT NULL) j ON s.sendid = j.sendid""",
    "sent", "jobs"))
def join_inner(t: Inputs) -> DataFrame:
    jobs = t.jobs.where("triggeredsendexternalkey IS NOT NULL").select("sendid", "emailname")
    return joins.inner(t.sent, jobs, ["sendid"]).select("subscriberid", "sendid", "eventdate", "emailname")


@query("join_left", twin("""SELECT m.customerkey, m.loyaltymemberkey, h.offercatalogcampaignkey, h.redemptiondate
    FROM mapping m LEFT JOIN hard h ON m.loyaltymemberkey = h.loyaltymemberkey""", "mapping", "hard"))
def join_left(t: Inputs) -> DataFrame:
    members = t.mapping.select("customerkey", "loyaltymemberkey")
    return joins.left_outer_many(members, t.hard, ["loyaltymemberkey"])


@query("join_left_multikey", twin("""SELECT s.subscriberid, s.sendid, s.eventdate, o.total_opens, u.unsub_time
    FROM sent s LEFT JOIN o ON s.subscriberid = o.subscriberid AND s.sendid = o.sendid
    LEFT JOIN u ON s.subscriberid = u.subscriberid AND s.sendid = u.sendid""",
    "sent", "opens", "unsubs", o=OPENS_SQL, u=UNSUBS_SQL))
def join_left_multikey(t: Inputs) -> DataFrame:
    keys = ["subscriberid", "sendid"]
    opens = aggregates.event_rollup(t.opens, ["subscriberkey", *keys], "eventdate", ("total_opens", "first", "last"))
    gone = aggregates.first_event(t.unsubs, ["subscriberkey", *keys], "eventdate", "unsub_time")
    sent = t.sent.select(*keys, "eventdate")
    opened = joins.left_outer(sent, opens.select(*keys, "total_opens"), keys)
    return joins.left_outer(opened, gone.select(*keys, "unsub_time"), keys)


@query("join_semi_in", twin("""SELECT subscriberid, sendid, eventdate FROM sent
    WHERE sendid IN (SELECT DISTINCT sendid FROM jobs WHERE upper(emailname) LIKE 'WJ%')""", "sent", "jobs"))
def join_semi_in(t: Inputs) -> DataFrame:
    journey = t.jobs.where(F.upper("emailname").like("WJ%")).select("sendid")
    return joins.semi_in(t.sent.select("subscriberid", "sendid", "eventdate"), journey, ["sendid"])


@query("existence_flag", twin(f"""SELECT contact_id, coalesce(control, 0) AS control, coalesce(offer2, 0) AS offer2,
    coalesce(offer3, 0) AS offer3 FROM mapping LEFT JOIN ({flags_sql("contact_id")}) listed USING (contact_id)""",
    "mapping", "controls", "controls_backup"))
def existence_flag(t: Inputs) -> DataFrame:
    listed = engagement.control_list(t.controls, t.controls_backup, "contact_id")
    flags = {kind: F.col("kind") == kind for kind in ("control", "offer2", "offer3")}
    return joins.membership_flags(t.mapping.select("contact_id"), "contact_id", listed, flags, "contact_id")


@query("join_key_in_range", twin("""SELECT x.loyaltymemberkey, checkkey, checkdate, created_date
    FROM transactions x JOIN (SELECT DISTINCT loyaltymemberkey, created_date FROM mapping
        WHERE loyaltymemberkey IS NOT NULL) m ON x.loyaltymemberkey = m.loyaltymemberkey
    WHERE checkdate BETWEEN created_date - 1 AND created_date + 90""", "transactions", "mapping"))
def join_key_in_range(t: Inputs) -> DataFrame:
    spans = t.mapping.where("loyaltymemberkey IS NOT NULL").select("loyaltymemberkey", "created_date").distinct()
    bought = t.transactions.select("loyaltymemberkey", "checkkey", "checkdate")
    return joins.within_days(bought, spans, ["loyaltymemberkey"], "checkdate", "created_date", 1, 90)


@query("join_dimension_default", twin("""SELECT opportunityid, market, coalesce(region, 'Others') AS region
    FROM conversion LEFT JOIN branches ON market = branch""", "conversion", "branches"))
def join_dimension_default(t: Inputs) -> DataFrame:
    rows = t.conversion.select("opportunityid", "market")
    return joins.dimension_default(rows, t.branches, "market", "branch", "region", "Others")


@query("fill_from_lookup", twin("""SELECT c.opportunityid, c.zip, coalesce(c.balance, l.balance) AS balance,
    coalesce(c.discount, l.discount) AS discount FROM conversion c
    LEFT JOIN (SELECT zip, max(balance) AS balance, max(discount) AS discount FROM conversion GROUP BY zip) l
    ON c.zip = l.zip""", "conversion"))
def fill_from_lookup(t: Inputs) -> DataFrame:
    rows = t.stored("conversion", "opportunityid", "zip", "balance", "discount")
    lookup = rows.groupBy("zip").agg(F.max("balance").alias("balance"), F.max("discount").alias("discount"))
    return joins.fill_from_lookup(rows, cut(lookup, "lookup"), "zip", ["balance", "discount"])


@query("anti_join_complement", twin("""SELECT opportunityid, won FROM conversion WHERE opportunityid NOT IN
    (SELECT opportunityid FROM conversion WHERE substr(md5(concat('2', opportunityid)), 1, 8) < 'cccccccc')""",
    "conversion"))
def anti_join_complement(t: Inputs) -> DataFrame:
    rows = t.conversion.select("opportunityid", "won")
    taken, _ = split_fraction(rows, "opportunityid", 0.8, "2")
    return joins.complement(rows, taken.select("opportunityid"), ["opportunityid"])


@query("agg_join_back", twin("""SELECT c.opportunityid, c.zip, round(a.m, 4) AS avg_zip_won_amount,
    round(a.b, 4) AS zip_median_balance, round(a.h, 4) AS zip_median_home_value FROM conversion c
    LEFT JOIN (SELECT zip, avg(won_amount) AS m, median(balance) AS b, median(home_value) AS h FROM conversion
        WHERE zip IS NOT NULL GROUP BY zip) a ON c.zip = a.zip""", "conversion"))
def agg_join_back(t: Inputs) -> DataFrame:
    rows = t.stored("conversion", "opportunityid", "zip", "won_amount", "balance", "home_value")
    means = rows.groupBy("zip").agg(F.avg("won_amount").alias("avg_zip_won_amount"))
    zips = means.join(medians_by(rows, ["zip"], ["balance", "home_value"], "zip_median_"), "zip")
    return rounded(joins.aggregate_back(rows.select("opportunityid", "zip"), zips, "zip"))


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    first = date(year, month, 1)
    return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))


def holiday_days(first: int, last: int) -> set[date]:
    """Holidays of the years, worked out on the calendar for the twin."""
    out = set()
    for y in range(first - 1, last + 2):
        last_may = date(y, 5, 31)
        out |= {
            _nth(y, 1, 0, 3), _nth(y, 2, 0, 3), last_may - timedelta(last_may.weekday()), _nth(y, 9, 0, 1),
            _nth(y, 10, 0, 2), _nth(y, 11, 3, 4),
        }
        fixed = [date(y, 1, 1), date(y, 7, 4), date(y, 11, 11), date(y, 12, 25)]
        for d in fixed + ([date(y, 6, 19)] if y >= 2021 else []):
            out.add(d)
            out |= {d - timedelta(1)} if d.weekday() == 5 else set()
            out |= {d + timedelta(1)} if d.weekday() == 6 else set()
    return out


HOLIDAYS_SQL = "SELECT CAST(d AS DATE) AS d FROM (VALUES " + ", ".join(
    f"('{d + timedelta(k)}')"
    for d, k in sorted({(d + timedelta(k), 0) for d in holiday_days(1994, 2026) for k in range(-2, 3)})
) + ") AS v(d)"


@query("near_holiday_flag", twin("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day,
    CASE WHEN CAST(o_orderdate AS DATE) IN (SELECT d FROM near) THEN 1 ELSE 0 END AS is_near_holiday FROM orders""",
    near=HOLIDAYS_SQL))
def near_holiday(t: Inputs) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return near_holiday_flag(rows, "day", holidays_of(rows, "day"))


@query("attach_target", twin("SELECT opportunityid, balance, discount, won FROM conversion", "conversion"))
def attach_target(t: Inputs) -> DataFrame:
    features = t.conversion.select("opportunityid", "balance", "discount")
    labels = t.conversion.select("opportunityid", "won")
    return joins.inner(features, labels, ["opportunityid"])


# --- sorts and sets --------------------------------------------------------


@query("sort_desc", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_acctbal DESC, c_custkey")
def sort_desc(t: Inputs) -> DataFrame:
    return t.customer.select("c_custkey", "c_acctbal", "c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")


@query("sort_custom_order", twin("SELECT fiscalmonth, count(*) AS n FROM conversion WHERE won = 1 GROUP BY 1",
                                 "conversion"))
def sort_custom_order(t: Inputs) -> DataFrame:
    sizes = aggregates.group_size(t.conversion.where("won = 1"), ["fiscalmonth"])
    return sizes.orderBy(aggregates.in_given_order(F.col("fiscalmonth"), MONTHS))


@query("union_all_distinct_keys", twin(
    "SELECT contact_id FROM (SELECT contact_id FROM controls_backup WHERE event_date IS NOT NULL "
    "UNION SELECT contact_id FROM controls WHERE control_event_date IS NOT NULL "
    "UNION SELECT contact_id FROM controls WHERE touch3_holdout_type IS NOT NULL) u", "controls", "controls_backup"))
def union_all_distinct_keys(t: Inputs) -> DataFrame:
    return joins.distinct_keys(
        [
            t.controls_backup.where("event_date IS NOT NULL").select("contact_id"),
            t.controls.where("control_event_date IS NOT NULL").select("contact_id"),
            t.controls.where("touch3_holdout_type IS NOT NULL").select("contact_id"),
        ]
    )


@query("concat_frames", """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier
    UNION ALL SELECT p_partkey, p_name, p_type FROM part""")
def concat_frames(t: Inputs) -> DataFrame:
    return frames.stack_frames(
        [
            t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment"),
            t.supplier.selectExpr("s_suppkey AS id", "s_name AS name"),
            t.part.selectExpr("p_partkey AS id", "p_type AS segment", "p_name AS name"),
        ]
    )
