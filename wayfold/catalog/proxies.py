"""Stand-ins for the journey and conversion inputs, derived from the test tables.

Each proxy is one SELECT that Spark and the checking engine both accept; its
inputs are written as ``{table}``. Spark runs it over the Parquet files, the
SQL twins carry it as a common table expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from wayfold.plans.offers import FREE_SIDE_KEYS, OFFER1_KEYS, OFFER2_KEYS, OFFER2_REWARDS, OFFER3_REWARDS
from wayfold.storage import cut

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Names of the twenty kinds of send jobs; later lists replace some of them for
# other job numbers, so that every offer variant and odd name occurs.
_NAMES = [
    "WJ_1.1_Brand_Welcome", "WJ_1.2_Brand_Nudge", "WJ_2.1_Post_Purchase", "WJ_2.2_Offer", "WJ_2.3_Nudge",
    "WJ_2.4_Nudge", "WJ_2.5_Nudge", "WJ_2.6_Nudge", "WJ_3.1_Post_Purchase", "RWJ_1.1_Brand",
    "WJ_3.2_Brand_Nudge_A", "WJ_3.3_Brand_Offer_Offer2A", "WJ_3.4_Nudge", "WJ_3.5_Nudge", "WJ_4.1_Post_Purchase",
    "WJ_4.2_Nudge", "WJ_4.3_Offer_Offer3A", "WJ_4.4_Nudge", "NTJ_2.8_Nudge", "WJ_1.3_Brand",
]
_OTHER_NAMES = {
    31: "WJ_3.3_Brand_Offer_Offer2B", 51: "WJ_3.3_Brand_Digital_Offer_2C2", 71: "WJ_V3_3.3_Brand_Offer_Digital_2D2",
    91: "WJ_3.3_Brand_Offer_2E", 36: "WJ_4.3_Offer_Offer3B", 56: "WJ_4.3_Nudge_Offer_3D", 76: "WJ_4.3_Offer_3B",
    96: "WJ_4.3_Digital_Offer_3D3", 80: "wj_1.1_brand_lower", 61: "Promo_WJ_9.9", 41: "WJ_1.4_Brand",
    40: "RWJ_1.1_Brand", 38: "WJ_2.8_Nudge", 52: "WJ_3.3_Brand_Offer_2D", 72: "WJ_3.3_X_Brand_Offer_Non_Digital_Offer_2A1",
    54: "WJ_3.3_X_Brand_Offer_Digital_Offer_2D", 74: "WJ_3.3_Brand_Offer_Offer2C",
}
JOB_NAMES = [_OTHER_NAMES.get(k, _NAMES[k % 20]) for k in range(100)]

COUPON_KEYS = [*OFFER1_KEYS, *OFFER2_KEYS, *FREE_SIDE_KEYS, "9999"]
REWARD_NAMES = [*dict.fromkeys([*OFFER2_REWARDS, *OFFER3_REWARDS]), "Unlisted"]
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def pick(index: str, values: list[str]) -> str:
    """CASE text that picks the value at a position of a fixed list."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_SUB = "concat('S', CAST(user_id AS STRING)) AS subscriberkey, user_id AS subscriberid"

PROXIES: dict[str, str] = {
    "sent": f"SELECT {_SUB}, {_K} AS sendid, ts AS eventdate FROM {{events}} WHERE event_type IN ('view', 'signup')",
    "jobs": (
        "SELECT sendid, name AS emailname, concat('Subject ', CAST(sendid % 7 AS STRING)) AS subject, "
        "CASE WHEN sendid % 10 <> 9 THEN concat('key', CAST(sendid AS STRING)) END AS triggeredsendexternalkey "
        f"FROM (SELECT DISTINCT {_K} AS sendid FROM {{events}}) j "
        f"JOIN (VALUES {', '.join(f"({k}, '{n}')" for k, n in enumerate(JOB_NAMES))}) AS v(k, name) ON sendid = k"
    ),
    "opens": f"SELECT {_SUB}, {_K} AS sendid, ts AS eventdate FROM {{events}} WHERE event_type = 'click'",
    "clicks": (
        f"SELECT {_SUB}, {_K} AS sendid, ts AS eventdate FROM {{events}} WHERE event_type = 'click' AND value > 20"
    ),
    "bounces": (
        f"SELECT {_SUB}, {_K} AS sendid, ts AS eventdate, "
        "CASE WHEN event_id % 2 = 0 THEN 'Hard bounce' ELSE 'Soft bounce' END AS bouncecategory "
        "FROM {events} WHERE event_type = 'error'"
    ),
    "unsubs": (
        f"SELECT {_SUB}, {_K} AS sendid, ts AS eventdate FROM {{events}} WHERE event_type = 'purchase' AND value < 5"
    ),
    "transactions": (
        "SELECT user_id AS loyaltymemberkey, event_id AS checkkey, "
        "CASE event_id % 5 WHEN 0 THEN 'IN STORE' WHEN 1 THEN 'WHITELABEL' WHEN 2 THEN 'ORDER AHEAD' "
        "WHEN 4 THEN 'MARKETPLACE' END AS purchase_channel, CAST(ts AS DATE) AS checkdate, ts AS checktime, "
        "value AS netsalesamount, CASE WHEN event_id % 11 <> 0 THEN 1 END AS txn_number_post_signup "
        "FROM {events} WHERE event_type = 'purchase'"
    ),
    "mapping": (
        "SELECT CASE WHEN c_custkey % 50 <> 13 THEN c_custkey END AS loyaltymemberkey, "
        "c_custkey + 1000000 AS customerkey, concat('L', CAST(c_custkey AS STRING)) AS loyalty_member_id, "
        "concat('X', CAST(c_custkey AS STRING)) AS external_id, concat('S', CAST(c_custkey AS STRING)) AS contact_id, "
        "c_custkey AS subscriberid, joined AS accountcreationdatetime, "
        "CASE WHEN c_custkey % 7 = 0 THEN CAST(joined AS DATE) - 1500 ELSE CAST(joined AS DATE) END AS signup_date, "
        "c_mktsegment AS cust_tag, CASE WHEN c_custkey % 3 = 0 THEN joined END AS first_touch, "
        "CASE WHEN c_custkey % 4 = 0 THEN CAST(joined AS DATE) END AS journey_join_date, "
        "CAST(joined AS DATE) AS created_date, "
        "CASE WHEN c_custkey % 10 = 0 THEN 'NTJ' ELSE 'WJ' END AS journey_type, "
        "CASE WHEN c_custkey % 10 IN (0, 1) THEN CAST(joined AS DATE) + 10 END AS ntj_entry_date, "
        "CASE WHEN c_custkey % 10 IN (0, 1) THEN 1 ELSE 0 END AS ntj_entry_flag, "
        "CASE WHEN c_custkey % 10 IN (1, 2) THEN CAST(joined AS DATE) + 5 END AS wj_re_entry_date, "
        "CASE WHEN c_custkey % 10 IN (1, 2) THEN 1 ELSE 0 END AS wj_re_entry_flag "
        "FROM {customer} JOIN (SELECT user_id, min(ts) AS joined FROM {events} WHERE event_type = 'signup' "
        "GROUP BY user_id) s ON c_custkey = user_id"
    ),
    "controls": (
        "SELECT concat('S', CAST(doc_id AS STRING)) AS contact_id, concat('X', CAST(doc_id AS STRING)) AS external_id, "
        "CASE WHEN toxic = 1 THEN 'WJ_CG' WHEN quality = 0 THEN 'wj_offer_2_holdout' "
        "WHEN doc_id % 9 = 0 THEN 'WJ_Offer_3_Holdout' ELSE 'none' END AS controlgroup, "
        "CASE WHEN doc_id % 29 <> 0 THEN DATE '2024-01-01' END AS control_event_date, "
        "CASE WHEN doc_id % 13 = 0 THEN 'A' END AS touch3_holdout_type, "
        "CASE WHEN doc_id % 17 = 0 THEN 'B' END AS touch4_holdout_type FROM {labels} WHERE doc_id % 2 = 1"
    ),
    "controls_backup": (
        "SELECT concat('S', CAST(doc_id AS STRING)) AS contact_id, concat('X', CAST(doc_id AS STRING)) AS external_id, "
        "CASE WHEN toxic = 1 THEN 'WJ_CG' WHEN quality = 0 THEN 'wj_offer_2_holdout' "
        "WHEN doc_id % 9 = 0 THEN 'WJ_Offer_3_Holdout' ELSE 'none' END AS controlgroup, "
        "CASE WHEN doc_id % 29 <> 0 THEN DATE '2024-01-01' END AS event_date FROM {labels} WHERE doc_id % 2 = 0"
    ),
    "hard": (
        f"SELECT user_id AS loyaltymemberkey, {pick(f'{_K} % {len(COUPON_KEYS)}', COUPON_KEYS)} "
        "AS offercatalogcampaignkey, CAST(ts AS DATE) AS redemptiondate "
        "FROM {events} WHERE event_type = 'purchase' AND value > 100"
    ),
    "soft": (
        f"SELECT user_id AS loyaltymemberkey, {pick(f'{_K} % {len(REWARD_NAMES)}', REWARD_NAMES)} AS name, "
        "CAST(ts AS DATE) AS redemptiondate, value * 10 AS total_points_awarded "
        "FROM {events} WHERE event_type = 'purchase' AND value BETWEEN 20 AND 100"
    ),
    "conversion": (
        "SELECT md5(concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', "
        "CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', "
        "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING))) AS opportunityid, "
        "o_custkey % 100 AS zip, CAST(s_nationkey AS STRING) AS county, CAST(c_nationkey AS STRING) AS state, "
        "n_name AS market, "
        "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS won, 1 AS opps, "
        "CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS won_amount, "
        "CAST(o_orderdate AS DATE) AS creationdate, CAST(year(o_orderdate) AS INT) AS fiscalyear, "
        f"{pick('month(o_orderdate) - 1', MONTHS)} AS fiscalmonth, CAST(weekofyear(o_orderdate) AS INT) AS fiscalweek, "
        "CASE WHEN l_partkey % 5 <> 0 THEN p_size END AS size_score, "
        "CASE WHEN o_custkey % 7 <> 0 THEN c_acctbal END AS balance, "
        "CASE WHEN l_discount <> 0 THEN l_discount END AS discount, "
        "l_quantity AS quantity, l_tax AS tax, p_retailprice AS home_value, "
        "CASE WHEN l_orderkey % 2 = 0 THEN l_extendedprice END AS mostly_missing_a, "
        "CASE WHEN l_orderkey % 5 = 0 THEN l_tax END AS mostly_missing_b, "
        "o_orderpriority AS response_channel, c_mktsegment AS opp_type, "
        "CASE WHEN l_partkey % 3 <> 0 THEN p_type END AS dwelling_type, "
        "CASE WHEN l_linestatus = 'O' THEN 'Y' WHEN l_linenumber <> 1 THEN 'N' END AS vacancy_indicator, "
        "chr(65 + p_size % 10) AS dwelling_unit_size, "
        "CASE WHEN l_discount <> 0 THEN concat(CAST(1 + l_suppkey % 9 AS STRING), chr(65 + CAST(l_linenumber AS INT) % 4)) "
        "END AS buying_power_score, "
        "CASE WHEN p_size = 50 THEN 1 WHEN p_size < 25 THEN 0 END AS waterfront_home, "
        "(CAST(l_quantity AS INT) * 13 + l_linenumber * 7) % 101 / 100.0E0 AS score "
        "FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey "
        "JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey "
        "JOIN {nation} ON c_nationkey = n_nationkey"
    ),
    "branches": (
        "SELECT n_name AS branch, r_name AS region FROM {nation} JOIN {region} ON n_regionkey = r_regionkey "
        "WHERE r_name <> 'ASIA'"
    ),
}


class Inputs:
    """The test tables and proxies of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A Parquet table; its schema is read once per query."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in PROXIES:
            sql = PROXIES[name]
            return self.spark.sql(sql, **{t: self.table(t) for t in _inputs(sql)})
        if name in BASE_TABLES:
            return self.table(name)
        raise AttributeError(name)


    def stored(self, name: str, *columns: str) -> DataFrame:
        """A proxy written to shared storage, for jobs that read it several times."""
        frame = getattr(self, name)
        return cut(frame.select(*columns) if columns else frame, name)


def _inputs(sql: str) -> list[str]:
    return [t for t in dict.fromkeys(re.findall(r"{(\w+)}", sql)) if t in BASE_TABLES]


def proxy_sql(name: str) -> str:
    """A proxy's SELECT with plain table names."""
    sql = PROXIES[name]
    for t in _inputs(sql):
        sql = sql.replace("{" + t + "}", t)
    return sql


def twin(body: str, *proxies: str, **views: str) -> str:
    """A SQL twin: proxies and further named SELECTs as common table expressions."""
    parts = [f"{p} AS ({proxy_sql(p)})" for p in proxies] + [f"{n} AS ({sql})" for n, sql in views.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
