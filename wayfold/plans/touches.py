"""Touch labels, the first send of each touch, and touch columns per member."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.rules import any_of, classify_like
from wayfold.operators.ordered import first_rows
from wayfold.operators.products import product_of_sets

# Send-name patterns and the touch each one stands for, in order.
TOUCH_LABELS: list[tuple[str, str]] = [
    ("WJ%1.1%", "WJ 1.1"),
    ("WJ%1.2%", "WJ 1.2"),
    ("WJ%1.3%", "WJ 1.3"),
    ("WJ%1.4%", "WJ 1.4"),
    ("WJ%2.1%", "WJ 2.1"),
    ("WJ%2.2%", "WJ 2.2"),
    ("WJ%2.3%", "WJ 2.3"),
    ("WJ%2.4%", "WJ 2.4"),
    ("WJ%2.5%", "WJ 2.5"),
    ("WJ%2.6%", "WJ 2.6"),
    ("WJ%3.1%", "WJ 3.1"),
    ("WJ%3.2%", "WJ 3.2"),
    ("%WJ%3.3%", "WJ 3.3"),
    ("WJ%3.4%", "WJ 3.4"),
    ("WJ%3.5%", "WJ 3.5"),
    ("WJ%4.1%", "WJ 4.1"),
    ("WJ%4.2%", "WJ 4.2"),
    ("WJ%4.4%", "WJ 4.4"),
    ("WJ%4.3%", "WJ 4.3"),
    ("%NTJ%2.8%", "NTJ 2.8"),
]


@dataclass(frozen=True)
class TouchRule:
    """Which sends fill a touch's columns: name patterns and an optional start.

    ``pattern`` is matched on the name as written, ``upper_any`` (if given) on
    the upper-cased name as well.
    """

    touch: str
    pattern: str | None = None
    upper_any: tuple[str, ...] = ()
    after: str | None = None

    def matches(self, name: Column, sent: Column) -> Column:
        """Condition on a send."""
        out = F.lit(True)
        if self.pattern:
            out = out & name.like(self.pattern)
        if self.upper_any:
            out = out & any_of(F.upper(name).like(p) for p in self.upper_any)
        if self.after:
            out = out & (sent > F.lit(datetime.fromisoformat(self.after)).cast("timestamp_ntz"))
        return out


# One rule per touch column group.
TOUCH_RULES: list[TouchRule] = [
    TouchRule("1_1", upper_any=("WJ%1.1%BRAND%",)),
    TouchRule("1_2", upper_any=("WJ%1.2%BRAND%",)),
    TouchRule("2_1", "WJ%2.1%"),
    TouchRule("2_2", "WJ%2.2%"),
    TouchRule("2_3", "WJ%2.3%"),
    TouchRule("2_4", "WJ%2.4%"),
    TouchRule("2_5", "WJ%2.5_Nudge"),
    TouchRule("2_6", "WJ%2.6%"),
    TouchRule("2_8", "%2.8%", upper_any=("%WJ%", "%NTJ%")),
    TouchRule("3_1", "WJ%3.1_Post_Purchase"),
    TouchRule("3_2", "WJ_3.2_Brand_Nudge%"),
    TouchRule("3_3", "%WJ%3.3_%", after="2020-11-01"),
    TouchRule("3_4", "WJ_%3.4%"),
    TouchRule("3_5", "WJ_%3.5_%"),
    TouchRule("4_1", "WJ%4.1_Post_Purchase"),
    TouchRule("4_2", "WJ%4.2%"),
    TouchRule("4_3", "WJ%4.3_%", after="2020-11-01"),
    TouchRule("4_4", "WJ_%4.4%"),
]

# Output suffix of each touch column and the send column behind it.
TOUCH_COLUMNS: dict[str, str] = {
    "tstamp": "senttime",
    "bounce_tstamp": "bounce_timestamp",
    "1st_open_tstamp": "first_open_timestamp",
    "1st_click_tstamp": "first_click_timestamp",
    "unsub_tstamp": "unsubscribed_timestamp",
}


def journey_job(name: Column) -> Column:
    """Sends that belong to the journey, by name; retired re-sends are out."""
    upper = F.upper(name)
    wanted = upper.like("%WJ%") | (upper.like("%NTJ%") & name.like("%2.8%"))
    return wanted & ~upper.like("%RWJ%")


def send_rollup(sent: DataFrame, jobs: DataFrame, rules: Sequence[tuple[str, str]] = TOUCH_LABELS) -> DataFrame:
    """Sends of journey jobs per (subscriber, name, subject, touch): first id and time."""
    live = jobs.where(journey_job(F.col("emailname")) & F.col("triggeredsendexternalkey").isNotNull())
    live = live.select("sendid", "emailname", "subject", classify_like(F.col("emailname"), rules).alias("touch_name"))
    return (
        sent.join(live, "sendid")
        .groupBy("subscriberkey", "subscriberid", "emailname", "subject", "touch_name")
        .agg(F.min("sendid").alias("sendid"), F.min("eventdate").alias("senttime"))
    )


def first_send_per_touch(rolled: DataFrame) -> DataFrame:
    """The earliest send of each (subscriber, touch); sends without a touch share one."""
    order = ["senttime", "sendid", "emailname", "subscriberid", "subject"]
    return first_rows(rolled, ["subscriberkey", "touch_name"], [F.col(c) for c in order])


def touch_columns(
    sends: DataFrame, rules: Sequence[TouchRule] = TOUCH_RULES, extra: dict[str, tuple[str, Column]] | None = None
) -> DataFrame:
    """Every combination of a subscriber's sends, one per touch, as wide columns.

    Equal to left-joining the sends once per touch: the distinct sends of each touch are the sets of
    a product, which is dealt over all tasks however many sends a subscriber has.
    ``extra`` adds named expressions to a touch's columns.
    """
    extra = extra or {}
    name, when = F.col("emailname"), F.col("senttime")
    sources = list(dict.fromkeys(TOUCH_COLUMNS.values()))
    matched = F.array_compact(F.array(*[F.when(rule.matches(name, when), F.lit(rule.touch)) for rule in rules]))
    placed = sends.where(F.col("subscriberid").isNotNull()).select(
        "subscriberid", *dict.fromkeys(["emailname", *sources]), F.explode_outer(matched).alias("slot")
    )
    fields = [F.col(source).alias(suffix) for suffix, source in TOUCH_COLUMNS.items()]
    fields += [F.when(F.col("slot") == touch, value).alias(label) for touch, (label, value) in extra.items()]
    items = placed.select("subscriberid", "slot", F.when(F.col("slot").isNotNull(), F.struct(*fields)).alias("item"))
    columns = []
    for rule in rules:
        columns += [F.col(f"{rule.touch}.{suffix}").alias(f"tch_{rule.touch}_{suffix}") for suffix in TOUCH_COLUMNS]
        if rule.touch in extra:
            columns.append(F.col(f"{rule.touch}.{extra[rule.touch][0]}"))
    return product_of_sets(items, ["subscriberid"], [rule.touch for rule in rules]).select("subscriberid", *columns)


def touch_pivot(
    sends: DataFrame, rules: Sequence[TouchRule] = TOUCH_RULES, extra: dict[str, tuple[str, Column]] | None = None
) -> DataFrame:
    """One row per subscriber: the earliest value of each touch column.

    The same as :func:`touch_columns` when a subscriber has at most one send
    per touch. ``extra`` expressions are taken from the first send.
    """
    name, when = F.col("emailname"), F.col("senttime")
    columns = [
        F.min(F.when(rule.matches(name, when), F.col(source))).alias(f"tch_{rule.touch}_{suffix}")
        for rule in rules
        for suffix, source in TOUCH_COLUMNS.items()
    ]
    for rule in rules:
        if rule.touch in (extra or {}):
            label, expression = extra[rule.touch]
            columns.append(F.min_by(expression, F.when(rule.matches(name, when), when)).alias(label))
    return sends.groupBy("subscriberid").agg(*columns)
