"""Touches, ladders, offers and purchases on hand-made frames."""

import itertools
from datetime import date, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from wayfold.catalog import members as sql
from wayfold.functions.dates import hours_crossed, week_ending_sunday
from wayfold.functions.rules import classify_like, map_values
from wayfold.operators.joins import membership_flags
from wayfold.plans import attribution, engagement, journey, offers, touches

DAY = datetime(2024, 1, 1, 12)


def grid(names, values):
    return [dict(zip(names, combo, strict=True)) for combo in itertools.product(values, repeat=len(names))]


LADDERS = {
    "1st": (attribution.attribute_first, ("1_2", "2_3", "2_4", "2_5", "2_8"), (None, 0, 2)),
    "2nd": (attribution.attribute_second, ("1_2", "2_1", "2_2", "3_2", "3_3", "3_4", "3_5"), (None, 0, 2)),
    "3rd": (attribution.attribute_third, ("3_1", "4_2", "4_3", "4_4"), (None, 0, 1, 2, 3)),
}


@pytest.mark.parametrize("nth", LADDERS)
def test_ladder_on_every_combination(nth, spark):
    build, names, values = LADDERS[nth]
    stamp = lambda d: None if d is None else DAY + timedelta(days=d)
    lines = []
    for combo in grid(names, values):
        for bought in (None, 0, 1, 2, 3):
            lines.append((len(lines), stamp(bought), *[stamp(combo[n]) for n in names]))
    columns = ["id", f"_{nth}_txn_date", *[f"t{n}" for n in names]]
    schema = "id int, " + ", ".join(f"{c} timestamp_ntz" for c in columns[1:])
    df = spark.createDataFrame(lines, schema)
    label = build(F.col(columns[1]), {n: F.col(f"t{n}") for n in names})
    mine = {r["id"]: r["label"] for r in df.select("id", label.alias("label")).collect()}
    frame = df.toPandas()  # noqa: F841
    expression = sql.attribution_sql(nth)
    for n in names:
        expression = expression.replace(f"t{n}.senttime", f"t{n}")
    theirs = dict(duckdb.sql(f"SELECT id, {expression} AS label FROM frame").fetchall())
    assert mine == theirs
    assert len(set(mine.values())) > 4


def test_offer_rules_on_every_combination(spark):
    variants2 = [*[r.variant for r in offers.OFFER2_RULES], None, "unknown"]
    variants3 = [*offers.OFFER3_CODES, None, "unknown"]
    keys = [None, *offers.OFFER2_KEYS]
    lines = [
        (v2, v3, key, d0, name, 120.0 if name else None, spend, side, one)
        for v2, v3 in itertools.zip_longest(variants2, variants3)
        for key in keys
        for d0 in ((None, "2024-02-01") if key else (None,))
        for name in (None, "Offer2A")
        for spend in (None, 8.5)
        for side in (None, "6369")
        for one in (None, "7120")
    ]
    schema = "v2 string, v3 string, k0 string, d0 string, n2 string, p2 double, spend double, side string, one string"
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "id int, " + schema).withColumns(
        {"d0": F.col("d0").cast("date"), "d2": F.when(F.col("n2").isNotNull(), F.lit(date(2024, 3, 1)))}
    )
    c = F.col
    coupon = offers.Redemption(c("d0"), key=c("k0"))
    reward = offers.Redemption(c("d2"), name=c("n2"), points=c("p2"))
    side = offers.Redemption(c("d0"), key=c("side"))
    first = offers.Redemption(c("d0"), key=c("one"))
    out = df.select(
        "id",
        *[
            e.alias(n)
            for n, e in {
                **offers.offer1_columns(first),
                **offers.offer2_columns(c("v2"), coupon, reward, c("spend")),
                **offers.offer3_columns(c("v3"), side, reward),
                "offer_3_3_variants_short": offers.offer2_code(c("v2")),
                "offer_4_3_variants_short": offers.offer3_code(c("v3")),
            }.items()
        ],
    )
    frame = df.toPandas()  # noqa: F841
    query = f"""WITH m AS (SELECT id, v2 AS offer_3_3_variants, v3 AS offer_4_3_variants, spend AS _2nd_txn_netsales,
            {{'offercatalogcampaignkey': k0, 'redemptiondate': d0}} AS second_coupon,
            {{'name': n2, 'redemptiondate': d2, 'total_points_awarded': p2,
              'loyaltymemberkey': CASE WHEN n2 IS NOT NULL THEN 1 END}} AS second_reward,
            {{'offercatalogcampaignkey': side, 'redemptiondate': d0,
              'loyaltymemberkey': CASE WHEN side IS NOT NULL THEN 1 END}} AS side_coupon,
            {{'offercatalogcampaignkey': one, 'redemptiondate': d0}} AS first_coupon FROM
            (SELECT * REPLACE (CAST(d0 AS DATE) AS d0, CAST(d2 AS DATE) AS d2, nullif(p2, 'NaN'::DOUBLE) AS p2,
             nullif(spend, 'NaN'::DOUBLE) AS spend) FROM frame)), n AS (SELECT *, second_reward AS third_reward FROM m)
        SELECT id, {sql.OFFER_LIST} FROM n {sql.OFFER_JOINS} ORDER BY id"""
    cur = duckdb.sql(query)
    names = [n for n in out.columns if n in cur.columns]
    fix = lambda v: round(v, 9) if isinstance(v, float) else v
    theirs = [tuple(fix(x) for x in r) for r in duckdb.sql(query).project(", ".join(names)).fetchall()]
    mine = [tuple(fix(x) for x in r) for r in out.select(*names).orderBy("id").collect()]
    assert mine == theirs
    assert len(names) == len(out.columns)


def test_classification(spark, rows):
    names = ["WJ_1.1_X", "WJ_1.2_1.1", "wj_1.1", "WJx1y1", "A_WJ_3.3", "A_WJ_3.2", "NTJ_2.8"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    found = dict(rows(df.select("name", classify_like(F.col("name"), touches.TOUCH_LABELS).alias("t"))))
    assert found == {
        "WJ_1.1_X": "WJ 1.1", "WJ_1.2_1.1": "WJ 1.1", "wj_1.1": None, "WJx1y1": None, "A_WJ_3.3": "WJ 3.3",
        "A_WJ_3.2": None, "NTJ_2.8": "NTJ 2.8",
    }


def test_map_values_keeps_unknown_null(spark, rows):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "x string")
    assert rows(df.select("x", map_values(F.col("x"), {"a": 1}).alias("y"))) == [("a", 1), ("z", None), (None, None)]


def test_hours_crossed(spark):
    pairs = [("10:59", "11:01", 1), ("10:01", "10:59", 0), ("11:01", "10:59", -1), ("10:00", None, None)]
    at = lambda s: s and datetime.fromisoformat(f"2024-03-10 {s}:00")
    df = spark.createDataFrame([(at(a), at(b), n) for a, b, n in pairs], "a timestamp_ntz, b timestamp_ntz, n int")
    assert df.where(~hours_crossed(F.col("a"), F.col("b")).eqNullSafe(F.col("n"))).count() == 0


def test_week_ending(spark):
    days = [(date(2024, 1, 7), date(2024, 1, 7)), (date(2024, 1, 6), date(2024, 1, 7)), (date(2024, 1, 8), date(2024, 1, 14))]
    df = spark.createDataFrame(days, "a date, b date")
    assert df.where(week_ending_sunday(F.col("a")) != F.col("b")).count() == 0


SEND = "subscriberkey string, subscriberid long, sendid long, eventdate timestamp_ntz"


def sends(spark, *lines):
    return spark.createDataFrame([(k, i, s, DAY + timedelta(hours=h)) for k, i, s, h in lines], SEND)


def tables(spark):
    """Two members; the first has two bounce categories and two subscriber keys for its opens."""
    empty = spark.createDataFrame([], SEND)
    jobs = spark.createDataFrame(
        [(1, "WJ_1.1_Brand", "s", "k"), (2, "WJ_1.1_Brand", "s", "k"), (3, "Promo_WJ", "s", "k"), (4, "X_WJ", "s", "k"),
         (5, "RWJ_1.1", "s", "k"), (6, "WJ_2.1", "s", None)],
        "sendid long, emailname string, subject string, triggeredsendexternalkey string",
    )
    sent = sends(spark, ("S1", 1, 2, 1), ("S1", 1, 1, 2), ("S1", 1, 3, 3), ("S1", 1, 4, 3), ("S2", 2, 1, 5), ("S2", 2, 5, 1),
                 ("S2", 2, 6, 1))
    opens = sends(spark, ("S1", 1, 1, 3), ("S1b", 1, 1, 4))
    bounces = sends(spark, ("S1", 1, 1, 3), ("S1", 1, 1, 4)).withColumn(
        "bouncecategory", F.when(F.hour("eventdate") == 15, "Hard").otherwise("Soft")
    )
    mapping = spark.createDataFrame(
        [(1, 1, "X1", None, None, date(2024, 1, 1), "WJ", 0, 0)],
        "subscriberid long, loyaltymemberkey long, external_id string, first_touch timestamp_ntz, "
        "journey_join_date date, created_date date, journey_type string, ntj_entry_flag int, wj_re_entry_flag int",
    )
    controls = spark.createDataFrame(
        [("S1", "WJ_CG", date(2024, 1, 1), None, None), ("S2", "wj_cg", None, "A", None)],
        "contact_id string, controlgroup string, control_event_date date, touch3_holdout_type string, "
        "touch4_holdout_type string",
    )
    backup = spark.createDataFrame(
        [("S2", "wj_offer_3_holdout", date(2024, 1, 1))], "contact_id string, controlgroup string, event_date date"
    )
    return engagement.EngagementTables(sent, jobs, opens, empty, bounces, empty, mapping, controls, backup)


def test_first_sends(spark, rows):
    t = tables(spark)
    rolled = touches.send_rollup(t.sent, t.jobs)
    # Both sends of one name fold into one row: least id, least time. Sends
    # without a touch share one place; the tie on time goes to the smaller id.
    assert rows(touches.first_send_per_touch(rolled), "subscriberkey", "touch_name", "sendid") == [
        ("S1", "WJ 1.1", 1), ("S1", None, 3), ("S2", "WJ 1.1", 1),
    ]


def test_engagement_master_fans_out(spark, rows):
    master = engagement.engagement_master(tables(spark))
    one = master.where("subscriberkey = 'S1' AND sendid = 1")
    # Two bounce categories times two opening keys.
    assert one.count() == 4
    assert {r["bouncetype"] for r in one.collect()} == {"Hard", "Soft"}
    assert rows(
        master.distinct(), "subscriberkey", "is_in_welcome_journey", "is_offer2_holdout", "is_offer3_holdout"
    ) == sorted([("S1", 0, 0, 0)] * 5 + [("S2", 1, 1, 1)], key=repr)


def test_touches_repeat_like_joins(spark, rows):
    master = engagement.engagement_master(tables(spark))
    wide = touches.touch_columns(master)
    # Four sends of touch 1.1 differ in bounce or opening time.
    assert wide.where("subscriberid = 1").count() == 4
    assert touches.touch_pivot(master).where("subscriberid = 1").count() == 1
    single = master.where("subscriberid = 2")
    columns = ["subscriberid", "tch_1_1_tstamp", "tch_2_1_tstamp"]
    assert rows(touches.touch_columns(single), *columns) == rows(touches.touch_pivot(single), *columns)


def test_one_send_per_touch_gives_one_row(spark, rows):
    master = engagement.engagement_master(tables(spark)).where("subscriberid = 2 OR sendid > 2")
    wide, once = journey.journey_touches(master), journey.first_touches(master)
    assert rows(wide, *sorted(once.columns)) == rows(once, *sorted(once.columns))
    repeated = engagement.engagement_master(tables(spark))
    assert journey.first_touches(repeated).count() == 2 < journey.journey_touches(repeated).count()


def test_membership_flags_never_repeat(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    listed = spark.createDataFrame([("a", 1), ("a", 2), (None, 1)], "m string, kind int")
    out = membership_flags(df, "k", listed, {"one": F.col("kind") == 1, "two": F.col("kind") == 2}, "m")
    assert rows(out, "k", "one", "two") == [("a", 1, 1), ("b", 0, 0), (None, 0, 0)]


MAPPING = (
    "loyaltymemberkey long, customerkey long, accountcreationdatetime timestamp_ntz, signup_date date, "
    "created_date date, ntj_entry_flag int, ntj_entry_date date, wj_re_entry_date date"
)
TXN = (
    "loyaltymemberkey long, checkkey long, purchase_channel string, checkdate date, checktime timestamp_ntz, "
    "netsalesamount double, txn_number_post_signup int"
)


def member(key, created, flag=0, moved=None, back=None):
    return (key, key, DAY, created, created, flag, moved, back)


def txn(key, check, day, channel="IN STORE", number=1):
    return (key, check, channel, day, datetime.combine(day, datetime.min.time()), 10.0 * check, number)


def test_purchases(spark, rows):
    start = date(2024, 1, 10)
    at = lambda n: start + timedelta(days=n)
    mapping = spark.createDataFrame(
        [member(1, start), member(2, start), member(3, start, 1), member(4, start, 1, at(9), at(5)), member(None, start)],
        MAPPING,
    )
    transactions = spark.createDataFrame(
        [
            txn(1, 5, at(-2)), txn(1, 6, at(-1)), txn(1, 8, at(90)), txn(1, 9, at(91)),
            txn(1, 7, at(3), None), txn(1, 10, at(4), "MARKETPLACE"), txn(1, 11, at(5), "WHITELABEL", None),
            txn(2, 23, at(1)), txn(2, 22, at(1)), txn(2, 21, at(1)), txn(2, 24, at(1)),
            txn(3, 31, at(1)), txn(4, 41, at(1)),
        ],
        TXN,
    )
    first = journey.first_three_transactions(transactions, mapping)
    columns = ["loyaltymemberkey", "_1st_txn_netsales", "_2nd_txn_netsales", "_3rd_txn_netsales", "days1_2_purchase"]
    # Member 3 is in the other journey; member 4 came back before entering it.
    assert rows(first, *columns) == [
        (1, 60.0, 80.0, None, 91), (2, 210.0, 220.0, 230.0, 0), (4, 410.0, None, None, None),
    ]
    totals = journey.totals_90_days(transactions, mapping)
    assert rows(totals) == [(1, 310.0, 4), (2, 900.0, 4), (4, 410.0, 1)]
    assert rows(journey.prior_transactions(transactions, mapping)) == [(1, 1)]


def test_open_alternative_admits_unlisted_members(spark):
    mapping = spark.createDataFrame(
        [member(None, date(2019, 1, 1), 1, date(2024, 2, 2), date(2024, 2, 1)), member(1, date(2019, 1, 1))], MAPPING
    )
    assert [r[0] for r in mapping.where(journey.in_this_journey()).select("loyaltymemberkey").collect()] == [None]


def test_exit(spark, rows):
    created = date(2024, 1, 1)
    df = spark.createDataFrame(
        [(1, DAY, created, None), (2, None, created, None), (3, None, created + timedelta(1), None), (4, DAY, created, created)],
        "id int, third timestamp_ntz, created date, moved date",
    )
    as_of = created + timedelta(91)
    out = df.select("id", *[e.alias(n) for n, e in attribution.journey_exit(F.col("third"), F.col("created"), F.col("moved"), as_of).items()])
    assert [r[:2] for r in rows(out)] == [(1, 1), (2, 1), (3, 0), (4, None)]
    assert rows(out)[1][2] == datetime(2024, 3, 31)
