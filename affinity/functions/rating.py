"""Column expressions that turn one user action into a time-decayed rating."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weight of each action label; any other label, or null, weighs 0.
ACTION_WEIGHTS = {
    "点击": 0.1,
    "分享": 0.15,
    "评论": 0.2,
    "收藏": 0.25,
    "点赞": 0.3,
}

# Days an article stays fresh, centre and slope of the decay curve.
AGING_DAYS = 14
DECAY_CENTRE = 7
DECAY_SLOPE = 0.8

DATE_PATTERN = "yyyyMMdd"


def days_since(date_text: Column, as_of: dt.date) -> Column:
    """Whole days from a ``yyyyMMdd`` text to ``as_of``; null when it does not parse."""
    return F.datediff(F.lit(as_of), F.try_to_date(date_text, DATE_PATTERN))


def action_weight(action: Column, weights: Mapping[str, float] = ACTION_WEIGHTS) -> Column:
    """Float weight of an action label, 0 for unknown labels and null."""
    if not weights:
        return F.lit(0.0).cast("float")
    labels = iter(weights.items())
    label, weight = next(labels)
    expr = F.when(action == label, F.lit(weight))
    for label, weight in labels:
        expr = expr.when(action == label, F.lit(weight))
    return expr.otherwise(F.lit(0.0)).cast("float")


def freshness(days: Column, aging_days: int = AGING_DAYS) -> Column:
    """Float weight in (0, 1) of an action some days old; 0 for a null age.

    The remaining life is ``aging_days - days``, and 1 once it is negative, fed
    to a logistic curve. It is not monotone: the last fresh day (life 0) weighs
    less than every older day (life 1).
    """
    life = F.lit(aging_days) - days
    life = F.when(life < 0, F.lit(1)).otherwise(life)
    x = (life - F.lit(DECAY_CENTRE)).cast("double") * F.lit(DECAY_SLOPE)
    weight = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.0) - x))
    return F.coalesce(weight.cast("float"), F.lit(0.0).cast("float"))


def time_weight(date_text: Column, as_of: dt.date, aging_days: int = AGING_DAYS) -> Column:
    """:func:`freshness` of a ``yyyyMMdd`` text; 0 for an unreadable date."""
    return freshness(days_since(date_text, as_of), aging_days)


def action_rating(
    action: Column,
    date_text: Column,
    as_of: dt.date,
    weights: Mapping[str, float] = ACTION_WEIGHTS,
    aging_days: int = AGING_DAYS,
) -> Column:
    """Single-precision product of :func:`action_weight` and :func:`time_weight`."""
    return action_weight(action, weights) * time_weight(date_text, as_of, aging_days)


def date_range(start: Column, end: Column) -> Column:
    """Array of ``yyyyMMdd`` texts from start to end, both included.

    An end on or before the start gives the start alone.
    """
    first = F.try_to_date(start, DATE_PATTERN)
    last = F.greatest(first, F.try_to_date(end, DATE_PATTERN))
    days = F.sequence(first, last, F.expr("interval 1 day"))
    return F.transform(days, lambda day: F.date_format(day, DATE_PATTERN))
