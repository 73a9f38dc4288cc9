"""The journey master: one member with purchases, offers, touches and exit.

Every fact table is reduced before it meets the member table: transactions to
the first three per member and day, or to daily sums; redemptions to distinct
used columns; sends to one set per touch. A member with any number of events
therefore never puts them all into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.dates import days_between, month_cohort, shift_days, week_ending_sunday
from wayfold.functions.rules import any_of, flag
from wayfold.operators.joins import between_days
from wayfold.operators.ordered import first_rows
from wayfold.operators.products import product_of_sets
from wayfold.plans.attribution import attribute_first, attribute_second, attribute_third, journey_exit
from wayfold.plans.engagement import control_flags, with_control_flags
from wayfold.plans.offers import (
    COUPON_VARIANTS,
    FREE_SIDE,
    FREE_SIDE_KEYS,
    OFFER1_KEYS,
    OFFER2_KEYS,
    OFFER2_REWARDS,
    OFFER2_VARIANTS,
    OFFER3_REWARDS,
    OFFER3_VARIANTS,
    REWARD_VARIANTS,
    Redemption,
    offer1_columns,
    offer2_code,
    offer2_columns,
    offer3_code,
    offer3_columns,
    variant_by_name,
)
from wayfold.plans.touches import TOUCH_RULES, touch_columns, touch_pivot
from wayfold.storage import cut

# Start of the programme, last signup day of old customers, the
# channel that does not count, and the two purchase media.
PROGRAMME_START = date(2020, 11, 14)
OLD_CUSTOMER_BEFORE = date(2020, 11, 10)
EXCLUDED_CHANNELS = ("MARKETPLACE",)
IN_STORE = ("IN STORE",)
DIGITAL = ("WHITELABEL", "ORDER AHEAD", "CATERING")

# Name patterns of the mails counted towards each purchase.
MAILS_BY_PURCHASE: dict[str, tuple[str, ...]] = {
    "1st": ("WJ%1.2%", "WJ%2.3%", "WJ%2.4%", "WJ%2.6%"),
    "2nd": ("WJ%2.1%", "WJ%2.2%", "WJ%3.2%", "%WJ%3.3%", "WJ%3.5%", "WJ%3.4%", "WJ%2.6%"),
    "3rd": ("WJ%3.1%", "WJ%4.2%", "WJ%4.1%", "WJ%4.3%", "WJ%4.4%"),
}

MEMBER = "loyaltymemberkey"
MEMBER_COLUMNS = [
    MEMBER, "customerkey", "loyalty_member_id", "external_id", "contact_id", "subscriberid",
    "accountcreationdatetime", "signup_date", "cust_tag", "first_touch", "journey_join_date", "created_date",
    "journey_type", "ntj_entry_date", "ntj_entry_flag", "wj_re_entry_date", "wj_re_entry_flag",
]


@dataclass(frozen=True)
class JourneyTables:
    """Input frames of the journey master."""

    mapping: DataFrame
    transactions: DataFrame
    engagement: DataFrame
    controls: DataFrame
    controls_backup: DataFrame
    hard_redemptions: DataFrame
    soft_redemptions: DataFrame


def in_programme(start: date = PROGRAMME_START) -> Column:
    """Members that joined on or after the programme start."""
    return F.col("created_date") >= F.lit(start)


def in_this_journey(start: date | None = PROGRAMME_START) -> Column:
    """Members of this journey, or back in it before entering the other one.

    The alternative stands beside the whole list of conditions, so it also
    admits members that fail them.
    """
    listed = F.col(MEMBER).isNotNull() & (F.col("ntj_entry_flag") == 0)
    if start:
        listed = listed & in_programme(start)
    return listed | (F.col("wj_re_entry_date") < F.col("ntj_entry_date"))


def purchase_medium(channel: Column) -> Column:
    """INSTORE or DIGITAL by sales channel."""
    return F.when(channel.isin(*IN_STORE), "INSTORE").when(channel.isin(*DIGITAL), "DIGITAL")


def first_three_transactions(transactions: DataFrame, mapping: DataFrame) -> DataFrame:
    """The first three purchases of the member's 90 days, side by side.

    Only the three earliest checks of each (member, day) can be among a
    member's first three, so all others are dropped before the join.
    """
    counted = transactions.where(
        F.col("txn_number_post_signup").isNotNull() & ~F.col("purchase_channel").isin(*EXCLUDED_CHANNELS)
    ).select(MEMBER, "checkkey", "purchase_channel", "checkdate", "checktime", "netsalesamount")
    few = first_rows(counted, [MEMBER, "checkdate"], [F.col("checkkey"), F.col("checktime")], 3)
    spans = mapping.where(in_this_journey()).select(
        MEMBER, "customerkey", "accountcreationdatetime", "signup_date", "ntj_entry_flag", "created_date"
    ).distinct()
    window = few.join(spans, MEMBER).where(between_days(F.col("checkdate"), F.col("created_date"), 1, 90))
    first = first_rows(
        window, [MEMBER], [F.col("checkdate"), F.col("checkkey"), F.col("checktime")], 3, number="n"
    )
    at = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    wide = first.groupBy(MEMBER).agg(
        at(1, "signup_date").alias("txn_signup_date"),
        *[
            at(n, source).alias(f"_{nth}_txn_{label}")
            for n, nth in ((1, "1st"), (2, "2nd"), (3, "3rd"))
            for source, label in (
                ("checktime", "date"),
                ("purchase_channel", "purchase_channel"),
                ("netsalesamount", "netsales"),
            )
        ],
    )
    return wide.withColumns(
        {
            "days1_2_purchase": days_between(F.col("_1st_txn_date"), F.col("_2nd_txn_date")),
            "days2_3_purchase": days_between(F.col("_2nd_txn_date"), F.col("_3rd_txn_date")),
        }
    )


def totals_90_days(transactions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Spend and transaction count in the member's 90 days, from daily sums."""
    daily = (
        transactions.where(F.col("txn_number_post_signup").isNotNull())
        .groupBy(MEMBER, "checkdate")
        .agg(F.sum("netsalesamount").alias("sales"), F.count("checkkey").alias("txns"))
    )
    spans = mapping.where(in_this_journey(None)).select(MEMBER, "created_date", "ntj_entry_flag").distinct()
    return (
        daily.join(spans, MEMBER)
        .where(between_days(F.col("checkdate"), F.col("created_date"), 1, 90))
        .groupBy(MEMBER)
        .agg(F.sum("sales").alias("total_sales_90_days"), F.sum("txns").alias("total_txns_90_days"))
    )


def prior_transactions(transactions: DataFrame, mapping: DataFrame, days: int = 2) -> DataFrame:
    """Distinct checks dated ``days`` or more before the member joined.

    A check counts if its earliest day does for the latest joining date, so
    checks are reduced to counts per (member, day) before the join.
    """
    first_day = (
        transactions.where(F.col("txn_number_post_signup").isNotNull() & F.col("checkkey").isNotNull())
        .groupBy(MEMBER, "checkkey")
        .agg(F.min("checkdate").alias("day"))
    )
    per_day = first_day.groupBy(MEMBER, "day").agg(F.count(F.lit(1)).alias("checks"))
    joined = mapping.where(in_programme()).groupBy(MEMBER).agg(F.max("created_date").alias("created"))
    return (
        per_day.join(joined, MEMBER)
        .where(F.col("day") <= F.date_sub("created", days))
        .groupBy(MEMBER)
        .agg(F.sum("checks").alias("txns_before_wj"))
    )


def eligibility_columns(signup: Column, prior: Column) -> dict[str, Column]:
    """Prior-purchase, old-customer and eligible flags."""
    had, old = prior > 0, signup < F.lit(OLD_CUSTOMER_BEFORE)
    return {
        "have_txns_before_wj_flag": flag(had),
        "oldcustomer_flag": flag(old),
        "is_eligible": F.when(had | old, 0).otherwise(1),
    }


def mails_received(engagement: DataFrame) -> DataFrame:
    """Distinct sends per subscriber and member, in all and towards each purchase."""
    name = F.col("emailname")
    nudged = (F.upper("emailname").like("%WJ%") | F.upper("emailname").like("%NTJ%")) & name.like("%2.8%")
    counts = [F.count_distinct("sendid").alias("total_mails_received")]
    for nth, patterns in MAILS_BY_PURCHASE.items():
        wanted = any_of(name.like(p) for p in patterns)
        if nth == "1st":
            wanted = wanted | nudged
        counts.append(
            F.count_distinct(F.when(wanted, F.col("sendid"))).alias(f"total_mails_received_{nth}_purchase")
        )
    return engagement.groupBy("subscriberkey", "subscriberid", MEMBER).agg(*counts)


def _variants() -> dict[str, tuple[str, Column]]:
    return {
        "3_3": ("offer_3_3_variants", variant_by_name(F.col("emailname"), OFFER2_VARIANTS)),
        "4_3": ("offer_4_3_variants", variant_by_name(F.col("emailname"), OFFER3_VARIANTS)),
    }


def journey_touches(engagement: DataFrame) -> DataFrame:
    """Touch columns with the offer texts of touches 3.3 and 4.3, every combination of sends."""
    return touch_columns(engagement, TOUCH_RULES, _variants())


def first_touches(engagement: DataFrame) -> DataFrame:
    """The same columns, one row per subscriber: each touch's earliest values."""
    return touch_pivot(engagement.where(F.col("subscriberid").isNotNull()), TOUCH_RULES, _variants())


def coupons(hard: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """Distinct (member, campaign key, date) of the given campaigns."""
    return hard.where(F.col("offercatalogcampaignkey").isin(*keys) & F.col(MEMBER).isNotNull()).select(
        MEMBER, F.col("offercatalogcampaignkey").alias(f"{prefix}_key"), F.col("redemptiondate").alias(f"{prefix}_date")
    ).distinct()


def rewards(soft: DataFrame, names: Sequence[str], prefix: str) -> DataFrame:
    """Distinct (member, name, date, points) of the given reward names."""
    return soft.where(F.col("name").isin(*names) & F.col(MEMBER).isNotNull()).select(
        MEMBER,
        F.col("name").alias(f"{prefix}_name"),
        F.col("redemptiondate").alias(f"{prefix}_date"),
        F.col("total_points_awarded").alias(f"{prefix}_points"),
    ).distinct()


def _coupon(prefix: str) -> Redemption:
    return Redemption(F.col(f"{prefix}_date"), key=F.col(f"{prefix}_key"))


def _reward(prefix: str) -> Redemption:
    return Redemption(F.col(f"{prefix}_date"), name=F.col(f"{prefix}_name"), points=F.col(f"{prefix}_points"))


def _join_if(rows: DataFrame, side: DataFrame, relevant: Column) -> DataFrame:
    other = side.withColumnRenamed(MEMBER, "__member")
    return rows.join(other, (F.col(MEMBER) == F.col("__member")) & relevant, "left").drop("__member")


def listed_members(t: JourneyTables) -> DataFrame:
    """Members of the programme with the control and holdout flags."""
    members = (
        t.mapping.where(F.col(MEMBER).isNotNull() & in_programme())
        .select(*MEMBER_COLUMNS)
        .distinct()
        .withColumnRenamed("contact_id", "subscriberkey")
    )
    flags = control_flags(t.controls, t.controls_backup, "external_id")
    return with_control_flags(members, flags, "external_id", "external_id")


def with_purchases(df: DataFrame, t: JourneyTables) -> DataFrame:
    """Attach first purchases, 90-day totals and earlier purchases of each member.

    They are stored as one table with a row per member, so that adaptive execution can split a
    member with many rows in the one join that remains.
    """
    bought = (
        first_three_transactions(t.transactions, t.mapping)
        .join(totals_90_days(t.transactions, t.mapping), MEMBER, "full")
        .join(prior_transactions(t.transactions, t.mapping), MEMBER, "full")
    )
    return df.join(cut(bought, "purchases"), MEMBER, "left")


def derive_member_columns(df: DataFrame, as_of: date) -> DataFrame:
    """Cohorts, eligibility, media, day gaps, journey flags and exit."""
    end = F.coalesce(F.col("_3rd_txn_date").cast("date"), shift_days(F.col("created_date"), 90))
    bought = {nth: F.col(f"_{nth}_txn_date") for nth in ("1st", "2nd", "3rd")}
    return df.withColumns(
        {
            "start_month_cohort": month_cohort(F.col("created_date")),
            "journey_cohort_week": week_ending_sunday(F.col("created_date")),
            "end_month_cohort": month_cohort(shift_days(F.col("created_date"), 90)),
            "journey_cohort_end_week": week_ending_sunday(end),
            **eligibility_columns(F.col("signup_date"), F.col("txns_before_wj")),
            **{
                f"_{nth}_txn_purchase_medium": purchase_medium(F.col(f"_{nth}_txn_purchase_channel"))
                for nth in bought
            },
            **{
                f"days_to_{nth}_txn_since_signup": days_between(F.col("txn_signup_date"), when)
                for nth, when in bought.items()
            },
            "is_in_1st_txn_journey": F.lit(1),
            "is_in_2nd_txn_journey": flag(bought["1st"].isNotNull()),
            "is_in_3rd_txn_journey": flag(bought["2nd"].isNotNull()),
            **journey_exit(bought["3rd"], F.col("created_date"), F.col("ntj_entry_date"), as_of),
        }
    ).drop("customerkey", "txn_signup_date", "txns_before_wj")


def member_base(t: JourneyTables, as_of: date) -> DataFrame:
    """Members with lists, purchases, totals, eligibility and exit; no touches or offers."""
    return derive_member_columns(with_purchases(listed_members(t), t), as_of)


def journey_parts(
    t: JourneyTables, as_of: date, touches: Callable[[DataFrame], DataFrame] = journey_touches
) -> dict[str, DataFrame]:
    """The journey master in four independent parts.

    ``members`` has everything but redemptions; ``offer1`` is keyed by member,
    ``offer2`` and ``offer3`` by member and variant. Each part has distinct rows
    and grows with the redemptions of its own offer only, where the master
    holds their product. A touch whose send has several rows (two bounce
    categories, say) repeats the member; ``touches=first_touches`` keeps one row
    per member whatever the sends look like.

    Joins on one key follow each other (lists, then subscriber, then member),
    so the wide rows are placed once per key.
    """
    mails = cut(mails_received(t.engagement).drop("subscriberkey", MEMBER), "mails")
    touched = listed_members(t).join(touches(t.engagement), "subscriberid", "left")
    placed = derive_member_columns(with_purchases(touched.join(mails, "subscriberid", "left"), t), as_of)
    variant2, variant3 = F.col("offer_3_3_variants"), F.col("offer_4_3_variants")
    touch = {rule.touch: F.col(f"tch_{rule.touch}_tstamp") for rule in TOUCH_RULES}
    members = cut(
        placed.withColumns(
            {
                "offer_3_3_variants_short": offer2_code(variant2),
                "offer_4_3_variants_short": offer3_code(variant3),
                "_1st_txn_attribution": attribute_first(F.col("_1st_txn_date"), touch),
                "_2nd_txn_attribution": attribute_second(F.col("_2nd_txn_date"), touch),
                "_3rd_txn_attribution": attribute_third(F.col("_3rd_txn_date"), touch),
            }
        ).distinct(),
        "members",
    )
    first = coupons(t.hard_redemptions, OFFER1_KEYS, "c1")
    # A coupon or reward only counts for rows whose variant can depend on it.
    second = members.select(MEMBER, "offer_3_3_variants", "_2nd_txn_netsales").distinct()
    second = _join_if(second, coupons(t.hard_redemptions, OFFER2_KEYS, "c2"), variant2.isin(*COUPON_VARIANTS))
    second = _join_if(second, rewards(t.soft_redemptions, OFFER2_REWARDS, "r2"), variant2.isin(*REWARD_VARIANTS))
    third = members.select(MEMBER, "offer_4_3_variants").distinct()
    third = _join_if(third, coupons(t.hard_redemptions, FREE_SIDE_KEYS, "c3"), variant3 == FREE_SIDE)
    third = _join_if(third, rewards(t.soft_redemptions, OFFER3_REWARDS, "r3"), F.lit(True))
    named = lambda columns: [e.alias(n) for n, e in columns.items()]
    spend = F.col("_2nd_txn_netsales")
    return {
        "members": members,
        "offer1": first.select(MEMBER, *named(offer1_columns(_coupon("c1")))).distinct(),
        "offer2": second.select(
            MEMBER, "offer_3_3_variants", *named(offer2_columns(variant2, _coupon("c2"), _reward("r2"), spend))
        ).distinct(),
        "offer3": third.select(
            MEMBER, "offer_4_3_variants", *named(offer3_columns(variant3, _coupon("c3"), _reward("r3")))
        ).distinct(),
    }


# The columns that decide which rows of a part go with a member's row.
PART_KEYS = {
    "members": (MEMBER, "offer_3_3_variants", "offer_4_3_variants"),
    "offer1": (MEMBER,),
    "offer2": (MEMBER, "offer_3_3_variants"),
    "offer3": (MEMBER, "offer_4_3_variants"),
}


def combine_parts(parts: dict[str, DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """Every distinct combination of a member's parts, with all or the given columns.

    The rows of the parts that share member and variants are the sets of a product, dealt over all
    tasks. With ``columns`` each part is reduced to the distinct values of those first, so the
    product is only as large as the columns need; rows may then repeat across variants.
    """
    on = PART_KEYS["members"]
    keys = [f"__key_{i}" for i in range(len(on))]
    renamed = dict(zip(on, keys, strict=True))
    groups = cut(parts["members"].select(*[F.col(c).alias(k) for c, k in renamed.items()]).distinct(), "member-keys")
    chosen = {}
    for name, part in parts.items():
        own = [c for c in part.columns if name == "members" or c not in on]
        chosen[name] = [c for c in own if columns is None or c in columns]
    fields = {name: F.struct(*[F.col(c) for c in own] or [F.lit(1).alias("__none")]) for name, own in chosen.items()}
    kinds = {name: parts[name].select(fields[name].alias("x")).schema["x"].dataType for name in parts}
    items = []
    for name, part in parts.items():
        shared = PART_KEYS[name]
        item = F.struct(*[(fields[n] if n == name else F.lit(None).cast(kinds[n])).alias(n) for n in parts])
        rows = part.select(*[F.col(c).alias(f"__own_{i}") for i, c in enumerate(shared)], item.alias("item"))
        if name == "members":
            rows = rows.withColumnsRenamed({f"__own_{i}": k for i, k in enumerate(keys)})
        else:
            same = [F.col(renamed[c]).eqNullSafe(F.col(f"__own_{i}")) for i, c in enumerate(shared)]
            rows = groups.join(rows.distinct(), reduce(lambda a, b: a & b, same))
        items.append(rows.select(*keys, F.lit(name).alias("slot"), "item"))
    made = product_of_sets(reduce(DataFrame.unionByName, items), keys, list(parts))
    out = {c: F.col(f"{name}.{name}.{c}") for name, own in chosen.items() for c in own}
    if "has_redeemed_offer1" in out:
        out["has_redeemed_offer1"] = F.coalesce(out["has_redeemed_offer1"], F.lit(0))
    return made.select(*[out[c].alias(c) for c in (columns or out)])


def journey_master(
    t: JourneyTables,
    as_of: date,
    touches: Callable[[DataFrame], DataFrame] = journey_touches,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The full member table, or some of its columns: every distinct combination of a member's parts."""
    return combine_parts(journey_parts(t, as_of, touches), columns)
