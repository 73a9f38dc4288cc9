"""Crediting a purchase to the touch before it, and leaving the journey."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.dates import days_between, shift_days
from wayfold.functions.rules import first_match

WITHOUT = "Without nudge"
JOURNEY_DAYS = 90


@dataclass(frozen=True)
class Rung:
    """A touch that earns purchases made after it and up to the next touch.

    Without a next touch it earns the purchase outright, or, if ``strict``,
    only a later one.
    """

    label: str
    touch: Column
    following: Column
    strict: bool = False

    def earns(self, bought: Column) -> Column:
        """Condition that this rung earns the purchase."""
        later = bought > self.touch
        alone = self.touch.isNotNull() & self.following.isNull()
        return (alone & later if self.strict else alone) | (later & (bought <= self.following))


def climb(
    bought: Column, none: Sequence[Column], rungs: Sequence[Rung], last: Sequence[tuple[Column, str]]
) -> Column:
    """First matching label: no nudge, then the rungs in order, then the tail.

    NULL without a purchase, or when nothing matches.
    """
    arms = [(condition, WITHOUT) for condition in none]
    arms += [(rung.earns(bought), rung.label) for rung in rungs]
    arms += list(last)
    return F.when(bought.isNotNull(), first_match(arms))


def expiry_tail(bought: Column, touch: Column, label: str, expired: str) -> list[tuple[Column, str]]:
    """The last touch earns purchases up to one day later; after that it expired."""
    gap = days_between(touch, bought)
    return [(gap <= 1, label), (gap > 1, expired)]


def attribute_first(bought: Column, touch: dict[str, Column]) -> Column:
    """Touch credited with the first purchase."""
    t12, t23, t24, t25, t28 = (touch[k] for k in ("1_2", "2_3", "2_4", "2_5", "2_8"))
    none = [
        t12.isNull() & t23.isNull(),
        bought < t12,
        t12.isNull() & (bought <= t23),
    ]
    rungs = [
        Rung("Touch 1.2", t12, t23, strict=True),
        Rung("Touch 2.3", t23, t24),
        Rung("Touch 2.4", t24, t25),
    ]
    return climb(bought, none, rungs, [(bought > t25, "Touch 2.5"), (bought > t28, "Touch 2.8")])


def attribute_second(bought: Column, touch: dict[str, Column], early: str = "1_2") -> Column:
    """Touch credited with the second purchase.

    A purchase before touch 2.2 or before the ``early`` touch has no nudge.
    """
    t21, t22, t32, t33, t34, t35 = (touch[k] for k in ("2_1", "2_2", "3_2", "3_3", "3_4", "3_5"))
    invited = t22.isNotNull() | t21.isNotNull()
    none = [invited & ((bought < t22) | (bought < touch[early])), ~invited]
    offers = [
        Rung("Touch 3.2", t32, t33),
        Rung("Touch 3.3", t33, t34),
        Rung("Touch 3.4", t34, t35),
    ]
    opening = (t32.isNull() | (bought <= t32), "Touch 2.1/2.2")
    arms = [(c, WITHOUT) for c in none] + [opening] + [(r.earns(bought), r.label) for r in offers]
    arms += expiry_tail(bought, t35, "Touch 3.5", "Post offer 2 Expiry")
    return F.when(bought.isNotNull(), first_match(arms))


def attribute_third(bought: Column, touch: dict[str, Column]) -> Column:
    """Touch credited with the third purchase."""
    t31, t42, t43, t44 = (touch[k] for k in ("3_1", "4_2", "4_3", "4_4"))
    none = [bought < t31, t31.isNull() & t42.isNull()]
    arms = [(c, WITHOUT) for c in none]
    arms.append((t42.isNull() & (bought > t31), "Touch 3.1"))
    arms += [(r.earns(bought), r.label) for r in (Rung("Touch 4.2", t42, t43), Rung("Touch 4.3", t43, t44))]
    arms += expiry_tail(bought, t44, "Touch 4.4", "Post offer 3 Expiry")
    return F.when(bought.isNotNull(), first_match(arms))


def journey_exit(third: Column, created: Column, moved_on: Column, as_of: date) -> dict[str, Column]:
    """Exited flag and date: the third purchase, or 90 days after joining.

    Both are NULL for a member who moved to the other journey (``moved_on`` is
    a date then). ``as_of`` stands for today.
    """
    stayed = moved_on.isNull()
    over = third.isNotNull() | (days_between(created, F.lit(as_of)) > JOURNEY_DAYS)
    left = F.coalesce(third, shift_days(created, JOURNEY_DAYS).cast("timestamp_ntz"))
    return {
        "has_exited_journey": F.when(stayed, F.when(over, 1).otherwise(0)),
        "date_exited_journey": F.when(stayed, left),
    }
