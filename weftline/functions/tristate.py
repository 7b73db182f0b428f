"""The three states of a measurement, and arithmetic that never turns a failed measurement into a zero.

MEASURED: the source answered with a value. ABSENT: it answered "nothing", a true measurement that enters
at a fixed low value. BLIND: it could not answer; its value is null and its weight leaves the denominator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEASURED, ABSENT, BLIND = "MEASURED", "ABSENT", "BLIND"
STATES = (MEASURED, ABSENT, BLIND)
NATURES = ("measured", "absent", "estimate", "derived", "floor")


def js_round(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits: halves go up, also below zero."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def known(value: Column, state: Column, weight: Column | None = None) -> Column:
    """Whether a part enters a composite."""
    ok = (state != BLIND) & value.isNotNull()
    return ok & (weight > 0) if weight is not None else ok


def state_of(value: Column, asked: Column) -> Column:
    """A left join's outcome: found, asked and not found, never asked."""
    return F.when(value.isNotNull(), MEASURED).when(asked, ABSENT).otherwise(BLIND)
