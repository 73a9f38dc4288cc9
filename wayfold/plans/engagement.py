"""The engagement master: one row per first send of a touch, with its outcomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.dates import hours_crossed
from wayfold.functions.rules import flag
from wayfold.operators.aggregates import event_rollup, first_event
from wayfold.operators.joins import semi_in
from wayfold.plans.touches import first_send_per_touch, send_rollup

SEND_KEY = ["subscriberkey", "subscriberid", "sendid"]


@dataclass(frozen=True)
class EngagementTables:
    """Input frames of the engagement master."""

    sent: DataFrame
    jobs: DataFrame
    opens: DataFrame
    clicks: DataFrame
    bounces: DataFrame
    unsubs: DataFrame
    mapping: DataFrame
    controls: DataFrame
    controls_backup: DataFrame


def control_list(current: DataFrame, backup: DataFrame, key: str) -> DataFrame:
    """(key, kind): members of the control group and of the two offer holdouts.

    ``kind`` is 'control', 'offer2' or 'offer3'; a member may occur many times.
    """
    named = {"wj_cg": "control", "wj_offer_2_holdout": "offer2", "wj_offer_3_holdout": "offer3"}
    group = F.lower("controlgroup")
    kind = F.coalesce(*[F.when(group == value, F.lit(label)) for value, label in named.items()])
    lists = [
        backup.where(F.col("event_date").isNotNull()).select(key, kind.alias("kind")),
        current.where(F.col("control_event_date").isNotNull()).select(key, kind.alias("kind")),
        current.where(F.col("touch3_holdout_type").isNotNull()).select(key, F.lit("offer2").alias("kind")),
        current.where(F.col("touch4_holdout_type").isNotNull()).select(key, F.lit("offer3").alias("kind")),
    ]
    out = lists[0]
    for frame in lists[1:]:
        out = out.unionByName(frame)
    return out.where(F.col("kind").isNotNull() & F.col(key).isNotNull())


def control_flags(current: DataFrame, backup: DataFrame, key: str) -> DataFrame:
    """One row per listed member with the three 0/1 flags."""
    has = lambda kind: F.max(flag(F.col("kind") == kind))
    return (
        control_list(current, backup, key)
        .groupBy(key)
        .agg(
            (1 - has("control")).alias("is_in_welcome_journey"),
            has("offer2").alias("is_offer2_holdout"),
            has("offer3").alias("is_offer3_holdout"),
        )
    )


def with_control_flags(df: DataFrame, flags: DataFrame, key: str, listed_key: str) -> DataFrame:
    """Attach the three flags; members on no list are in the journey, not held out."""
    one = flags.withColumnRenamed(listed_key, key)
    return df.join(one, key, "left").withColumns(
        {
            "is_in_welcome_journey": F.coalesce("is_in_welcome_journey", F.lit(1)),
            "is_offer2_holdout": F.coalesce("is_offer2_holdout", F.lit(0)),
            "is_offer3_holdout": F.coalesce("is_offer3_holdout", F.lit(0)),
        }
    )


def first_touch(sent: DataFrame, jobs: DataFrame) -> DataFrame:
    """First journey send per subscriber."""
    journey = jobs.where(F.upper("emailname").like("WJ%")).select("sendid")
    return semi_in(sent, journey, ["sendid"]).groupBy("subscriberkey", "subscriberid").agg(
        F.min("eventdate").alias("first_touch")
    )


def engagement_master(t: EngagementTables) -> DataFrame:
    """First sends joined to opens, clicks, bounces, unsubscribes, members and lists.

    Each event table is aggregated before its join; the four joins on
    (subscriberid, sendid) share one placement of the sends, the two on
    subscriberid another.
    """
    sends = first_send_per_touch(send_rollup(t.sent, t.jobs)).drop("touch_name")
    per_send = ["subscriberid", "sendid"]
    opens = event_rollup(
        t.opens, SEND_KEY, "eventdate", ("total_opens", "first_open_timestamp", "last_open_timestamp")
    ).drop("subscriberkey")
    clicks = event_rollup(
        t.clicks, SEND_KEY, "eventdate", ("total_clicks", "first_click_timestamp", "last_click_timestamp")
    ).drop("subscriberkey")
    bounces = first_event(
        t.bounces.withColumnRenamed("bouncecategory", "bouncetype"),
        [*SEND_KEY, "bouncetype"],
        "eventdate",
        "bounce_timestamp",
    ).select(*per_send, "bouncetype", "bounce_timestamp", F.lit(1).alias("bounced"))
    unsubs = first_event(t.unsubs, SEND_KEY, "eventdate", "unsub_time").select(
        *per_send, "unsub_time", F.lit(1).alias("left_list")
    )
    members = t.mapping.where(F.col("subscriberid").isNotNull()).select(
        "subscriberid",
        "loyaltymemberkey",
        "external_id",
        F.col("first_touch").alias("member_first_touch"),
        "journey_join_date",
        "created_date",
        "journey_type",
        "ntj_entry_flag",
        "wj_re_entry_flag",
        F.lit(1).alias("mapped"),
    )
    touched = first_touch(t.sent, t.jobs).drop("subscriberkey")
    joined = sends
    for side in (opens, clicks, bounces, unsubs):
        joined = joined.join(side, per_send, "left")
    for side in (members, touched):
        joined = joined.join(side, "subscriberid", "left")
    flagged = with_control_flags(
        joined, control_flags(t.controls, t.controls_backup, "contact_id"), "subscriberkey", "contact_id"
    )
    gone = F.col("left_list").isNotNull() & F.col("mapped").isNotNull()
    return flagged.select(
        "loyaltymemberkey",
        "external_id",
        "subscriberkey",
        "subscriberid",
        "journey_type",
        "ntj_entry_flag",
        "wj_re_entry_flag",
        "first_touch",
        "created_date",
        F.coalesce("journey_join_date", "member_first_touch", "first_touch").alias("journey_join_date"),
        "is_in_welcome_journey",
        "is_offer2_holdout",
        "is_offer3_holdout",
        "sendid",
        "senttime",
        "emailname",
        "subject",
        F.coalesce("bounced", F.lit(0)).alias("isbounced"),
        "bouncetype",
        "bounce_timestamp",
        "total_opens",
        "first_open_timestamp",
        "last_open_timestamp",
        "total_clicks",
        "first_click_timestamp",
        "last_click_timestamp",
        hours_crossed(F.col("senttime"), F.col("first_open_timestamp")).alias("time_to_first_open"),
        hours_crossed(F.col("first_open_timestamp"), F.col("first_click_timestamp")).alias(
            "time_to_1st_click_from_1st_open"
        ),
        flag(gone).alias("has_unsubscribed"),
        F.when(gone, F.col("unsub_time")).alias("unsubscribed_timestamp"),
    ).distinct()
