"""Number and date columns of the scoring model."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Citations that saturate the citation signal.
SATURATION = 1000
NEUTRAL_EFFORT = 5.0


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def clamp_effort(x: Column) -> Column:
    """Into [1, 10]; what is no number counts as 5."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x), NEUTRAL_EFFORT).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(1.0), x)))


def citation_signal(count: Column) -> Column:
    known = F.coalesce(count, F.lit(0)).cast("double")
    return F.when(known <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log10(known + 1) / math.log10(1 + SATURATION)))


def cost_effort(cost: Column) -> Column:
    """Small 2, large 8, medium and anything else 5; small is looked for first, then large."""
    c = F.lower(F.trim(F.coalesce(cost, F.lit(""))))
    small = c.startswith("s") | c.rlike("small|low|trivial")
    large = c.startswith("l") | c.rlike("large|high|hard")
    return F.when(c == "", 5.0).when(small, 2.0).when(large, 8.0).otherwise(5.0)


def age_days(published: Column, now: Column) -> Column:
    """Whole days, rounded down; negative for what is to come."""
    return F.floor((F.unix_micros(now) - F.unix_micros(published)) / 86_400_000_000).cast("long")


def populated(x: Column, is_array: bool = False) -> Column:
    """Neither null nor blank nor empty."""
    return F.coalesce(F.size(x) > 0 if is_array else x.rlike(r"(?U)\S"), F.lit(False))


def rice(impact: Column, applicability: Column, confidence: Column, effort: Column) -> Column:
    return impact * applicability * confidence / effort
