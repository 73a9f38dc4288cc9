"""Offer variants, redemptions and their cost, from rule tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.rules import any_of, first_match, flag, map_values

# Fixed value: cost of one loyalty point in dollars.
POINT_COST = 0.0044

# Send name to second-offer text, first match wins. "=" compares
# the whole name, "~" is a LIKE pattern.
OFFER2_VARIANTS: list[tuple[tuple[str, ...], str]] = [
    (("=WJ_3.3_Brand_Offer_Offer2A",), "Choice of Side with Chips + 2x points multiplier on next purchase"),
    (("=WJ_3.3_Brand_Offer_Offer2B",), "Free Fountain Drink + 2x points multiplier on the order"),
    (("=WJ_3.3_Brand_Offer_Offer2C",), "250 bonus points"),
    (("=WJ_3.3_Brand_Offer_Offer2D",), "300 Bonus points on order-ahead or delivery purchase"),
    (
        ("~WJ_3.3_Brand_Digital_Offer_2B%", "~WJ_V3_3.3 Brand Offer Digital 2B%"),
        "Free Fountain Drink + 2x points multiplier on the order",
    ),
    (("~WJ_3.3_Brand_Digital_Offer_2C2%", "~WJ_V3_3.3 Brand Offer Digital 2C2%"), "Get $0 Delivery Fee"),
    (
        ("~WJ_3.3_Brand_Digital_Offer_2D2%", "~WJ_V3_3.3_Brand_Offer_Digital_2D2"),
        "Free Fountain Drink + 3x points multiplier on the order",
    ),
    (("~WJ_3.3_Brand_Offer_2A",), "Choice of Side with Chips + 2x points multiplier on next purchase"),
    (("~WJ_3.3_Brand_Offer_2D",), "2x points on next purchase"),
    (("~WJ_3.3_Brand_Offer_2E", "~WJ_V3_3.3_Non_Digital_Nudge_offer_2E"), "150 bonus points on next purchase"),
    (("~WJ%3.3%Brand_Offer_Non_Digital_Offer_2A1",), "Free Fountain Drink"),
    (("~WJ%3.3%Brand_Offer_Non_Digital_Offer_2A2",), "Free Side and Chips"),
    (("~WJ%3.3%Brand_Offer_Non_Digital_Offer_2C",), "Free Fountain Drink with Chips"),
    (("~WJ%3.3%Brand_Offer_Non_Digital_Offer_2F",), "350 bonus points on click"),
    (("~WJ%3.3%Brand_Offer_Digital_Offer_2D",), "3x points on next purchase"),
]

# Send name to third-offer text, same notation.
OFFER3_VARIANTS: list[tuple[tuple[str, ...], str]] = [
    (("=WJ_4.3_Offer_Offer3A", "~WJ_V3_4.3_Offer_3A"), "150 Bonus points on next purchase"),
    (("=WJ_4.3_Offer_Offer3B",), "2X points on next purchase"),
    (("=WJ_4.3_Offer_Offer3C",), "150 Bonus points on order-ahead or delivery purchase"),
    (("~WJ_4.3_Digital_Offer_3C_SL%",), "150 Bonus points on order-ahead or delivery purchase"),
    (("~WJ_4.3_Digital_Offer_3D_SL%",), "Free Side"),
    (("~WJ_4.3_Nudge_Offer_3D", "~WJ_V3_4.3_Offer_3D"), "Free Side"),
    (("~WJ_4.3_Nudge_Offer_3A",), "150 Bonus points on next purchase"),
    (("~WJ%4.3%Offer_3B",), "200 Bonus points on next purchase"),
    (("~WJ%4.3%Offer_3D3",), "3X points on digital purchase"),
]

# Campaign keys of the first offer, and of the free-side offer.
OFFER1_KEYS = ("6036", "2371", "6964", "7120")
FREE_SIDE_KEYS = ("6369", "6463")
FREE_SIDE = "Free Side"
FREE_SIDE_NAME = "Offer 3D: Free Side"
FREE_SIDE_COST = 0.70

# Names under which point rewards of the offers are booked.
OFFER2_REWARDS = (
    "SFMC Welcome Journey TEST",
    "Welcome Journey Offer 2-A",
    "Welcome Journey Offer 2-B",
    "Welcome Journey Offer 2C",
    "SFMC Welcome Journey Offer 2D",
    "Welcome Journey 2D-2 3x Points",
    "Welcome Journey 2D-2 3x Points - Replatformed",
    "SFMC Welcome Journey Offer 2 b TEST",
    "SFMC Welcome Journey Offer 2",
    "SFMC Welcome Journey Offer 2A",
    "SFMC Welcome Journey Offer 2B",
    "SFMC Welcome Journey Offer 2C",
    "SFMC Welcome Journey Offer 2-D",
    "Welcome Journey 2-D reconfig",
    "SFMC Welcome Journey Offer 2 - Replatformed",
    "SFMC Welcome Journey Offer 2A - Replatformed",
    "SFMC Welcome Journey Offer 2B - Replatformed",
    "SFMC Welcome Journey Offer 2C - Replatformed",
    "SFMC Welcome Journey Offer 2-D - Replatformed",
    "Welcome, 2D Non-Digital, 2x Points",
    "Welcome, 2E Non-Digital, 150 Points",
    "SFMC Welcome Journey Phase 2+3 Events",
    "Offer2A",
    "Offer2B",
    "Offer2C",
    "Offer2D_300",
    "Offer_2F",
    "Offer2D_2",
    "Offer_2D",
    "Offer_2E",
    "Offer_2D_3x",
)
OFFER3_REWARDS = (
    "Welcome Journey Offer 3A",
    "Welcome Journey Offer 3B",
    "Welcome Journey Offer 3C",
    "SFMC Welcome Journey Offer 3",
    "SFMC Welcome Journey Offer 3A",
    "SFMC Welcome Journey Offer 3B",
    "SFMC Welcome Journey Offer 3C",
    "SFMC Welcome Journey Offer 3 - Replatformed",
    "Welcome Journey Offer 3A - Replatformed",
    "Welcome Journey Offer 3B - Replatformed",
    "Welcome Journey Offer 3C - Replatformed",
    "SFMC Welcome Journey Phase 2+3 Events",
    "Offer3A",
    "Offer3B",
    "Offer3C",
    "Offer_3B",
    "Offer3D3",
)


@dataclass(frozen=True)
class OfferRule:
    """How one variant of the second offer is redeemed and what it costs.

    ``keys`` are the coupon campaigns that count; ``points`` says a point reward
    counts too. ``booked_as`` fixes the redeemed name (else the reward's name).
    ``cost`` is the coupon cost; ``spend_factor`` prices points by spend when no
    reward is booked. ``cost_always`` and ``points_always`` apply the price
    whether or not the offer was redeemed.
    """

    variant: str
    code: str
    keys: tuple[str, ...] = ()
    points: bool = False
    booked_as: str | None = None
    cost: float = 0.0
    cost_always: bool = False
    points_always: bool = False
    spend_factor: int | None = None


# The second offer's variants.
OFFER2_RULES: list[OfferRule] = [
    OfferRule(
        "Choice of Side with Chips + 2x points multiplier on next purchase",
        "Offer2A", ("6034",), points=True, cost=0.72, spend_factor=10,
    ),
    OfferRule(
        "Free Fountain Drink + 2x points multiplier on the order",
        "Offer2B", ("6035", "6085"), points=True, cost=0.22, spend_factor=10,
    ),
    OfferRule("250 bonus points", "Offer2C", points=True, cost_always=True),
    OfferRule("300 Bonus points on order-ahead or delivery purchase", "Offer2D", points=True, cost_always=True),
    OfferRule(
        "Get $0 Delivery Fee", "Offer2C_2", ("6371",), booked_as="Offer2C_2", cost=1.0, points_always=True
    ),
    OfferRule(
        "Free Fountain Drink + 3x points multiplier on the order",
        "Offer2D_2", ("6368", "6367"), points=True, booked_as="Offer2D_2", cost=0.22, spend_factor=20,
    ),
    OfferRule("2x points on next purchase", "Offer_2D", points=True, cost_always=True, points_always=True),
    OfferRule("Free Fountain Drink", "Offer_2A1", ("7026",), booked_as="Offer_2A1", cost=0.22),
    OfferRule("Free Side and Chips", "Offer_2A2", ("7027",), booked_as="Offer_2A2", cost=1.20),
    OfferRule(
        "Free Fountain Drink with Chips", "Non Digital Offer2C", ("7032",), booked_as="Non Digital Offer2C", cost=0.22
    ),
    OfferRule("350 bonus points on click", "Offer_2F", points=True),
    OfferRule("3x points on next purchase", "Offer_2D_3x", points=True),
    OfferRule("150 bonus points on next purchase", "Offer_2E", points=True, cost_always=True, points_always=True),
]

# The third offer's variants and their short codes.
OFFER3_CODES: dict[str, str] = {
    "150 Bonus points on next purchase": "Offer3A",
    "2X points on next purchase": "Offer3B",
    "150 Bonus points on order-ahead or delivery purchase": "Offer3C",
    "200 Bonus points on next purchase": "Non Digital Offer3B",
    "3X points on digital purchase": "Offer3D3",
    FREE_SIDE: "Offer3D",
}

COUPON_VARIANTS = tuple(r.variant for r in OFFER2_RULES if r.keys)
REWARD_VARIANTS = tuple(r.variant for r in OFFER2_RULES if r.points)
OFFER2_KEYS = tuple(sorted({k for rule in OFFER2_RULES for k in rule.keys}))


def variant_by_name(name: Column, variants: Sequence[tuple[tuple[str, ...], str]]) -> Column:
    """Offer text of a send name; NULL when no rule matches."""
    test = lambda p: (name == p[1:]) if p[0] == "=" else name.like(p[1:])
    return first_match([(any_of(test(p) for p in patterns), text) for patterns, text in variants])


def offer2_code(variant: Column) -> Column:
    """Short code of a second-offer variant."""
    return map_values(variant, {r.variant: r.code for r in OFFER2_RULES})


def offer3_code(variant: Column) -> Column:
    """Short code of a third-offer variant."""
    return map_values(variant, OFFER3_CODES)


def points_cost(points: Column) -> Column:
    """Dollar cost of awarded points."""
    return points * F.lit(POINT_COST)


def spend_points_cost(spend: Column, factor: int) -> Column:
    """Dollar cost of ``factor`` points per dollar spent."""
    return spend * F.lit(factor) * F.lit(POINT_COST)


@dataclass(frozen=True)
class Redemption:
    """Columns of one coupon or point redemption; ``key`` or ``name`` is NULL when absent."""

    date: Column
    key: Column | None = None
    name: Column | None = None
    points: Column | None = None


def offer1_columns(coupon: Redemption) -> dict[str, Column]:
    """Flag and date of the first offer."""
    taken = coupon.key.isin(*OFFER1_KEYS)
    return {
        "has_redeemed_offer1": flag(taken),
        "redemption_date_offer1": F.when(taken, coupon.date),
    }


def _redeemed(rule: OfferRule, coupon: Redemption, reward: Redemption) -> Column:
    by_coupon = coupon.key.isin(*rule.keys) if rule.keys else F.lit(False)
    by_points = reward.name.isNotNull() if rule.points else F.lit(False)
    return by_coupon | by_points


def offer2_columns(
    variant: Column, coupon: Redemption, reward: Redemption, spend: Column, rules: Sequence[OfferRule] = OFFER2_RULES
) -> dict[str, Column]:
    """Redeemed name, flag, date, coupon cost and point cost of the second offer."""
    name, taken, when, hard, soft = [], [], [], [], []
    for rule in rules:
        mine = variant == rule.variant
        hit = mine & _redeemed(rule, coupon, reward)
        sources = ([coupon.date] if rule.keys else []) + ([reward.date] if rule.points else [])
        if not rule.points:
            price = F.lit(0.0)
        elif rule.spend_factor:
            price = F.coalesce(points_cost(reward.points), spend_points_cost(spend, rule.spend_factor))
        else:
            price = points_cost(reward.points)
        name.append((hit, F.lit(rule.booked_as) if rule.booked_as else reward.name))
        taken.append((hit, 1))
        when.append((hit, F.coalesce(*sources)))
        hard.append((mine if rule.cost_always else hit, rule.cost))
        soft.append((mine if rule.points_always else hit, price))
    return {
        "offer_3_3_variant_redeemed": first_match(name),
        "has_redeemed_offer2": first_match(taken),
        "redemption_date_offer2": first_match(when),
        "redemption_hard_cost_offer2": first_match(hard),
        "redemption_points_cost_offer2": first_match(soft),
    }


def offer3_columns(variant: Column, free_side: Redemption, reward: Redemption) -> dict[str, Column]:
    """The same five columns for the third offer.

    Point variants need a booked reward; the free side needs its own coupon.
    """
    side = variant == FREE_SIDE
    other = variant.isin(*[v for v in OFFER3_CODES if v != FREE_SIDE])
    side_hit = side & free_side.key.isNotNull()
    points_hit = other & reward.name.isNotNull()
    return {
        "offer_4_3_variant_redeemed": F.coalesce(reward.name, F.when(side_hit, F.lit(FREE_SIDE_NAME))),
        "has_redeemed_offer3": F.when(points_hit | side_hit, 1),
        "redemption_date_offer3": F.when(points_hit, reward.date).when(side_hit, free_side.date),
        "redemption_hard_cost_offer3": F.when(other, 0.0).when(
            side & free_side.key.isin(*FREE_SIDE_KEYS), FREE_SIDE_COST
        ),
        "redemption_point_cost_offer3": F.when(points_hit, points_cost(reward.points)).when(side, 0.0),
    }
