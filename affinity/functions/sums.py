"""Sums that do not depend on the order in which tasks deliver their parts.

Doubles are not associative: a shuffle that delivers the same values in another order gives
other last bits, and so other ranks among near-equal scores. Here every value is cut into
whole multiples of two powers of two. Sums of whole numbers are exact, so any order and any
number of partitions gives the same bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_COARSE, _FINE = 2.0**32, 2.0**63
_UNIT = 2.0**62


def exact_sum(value: Column, times: Column | None = None) -> Column:
    """The sum of doubles, the same for every order of the rows; with ``times`` a value counts
    that often, as if its row were there so many times.

    A value keeps what it has down to 2**-63. The magnitudes of a group may add up to 2**31;
    beyond that the sum overflows, which is an error, not a wrong result.
    """
    value = value.cast("double")
    coarse = F.rint(value * _COARSE)
    fine = F.rint((value - coarse / _COARSE) * _FINE)
    parts = [part.cast("bigint") if times is None else part.cast("bigint") * times for part in (coarse, fine)]
    return F.sum(parts[0]).cast("double") / _COARSE + F.sum(parts[1]).cast("double") / _FINE


def exact_unit_sum(value: Column) -> Column:
    """:func:`exact_sum` where the magnitudes of a group add up to 1 at most; one sum of whole
    multiples of 2**-62."""
    return F.sum(F.rint(value * _UNIT).cast("bigint")).cast("double") / _UNIT
