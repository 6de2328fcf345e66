"""Scores of demand, popularity and destinations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
TAG_PREFERENCE = {
    "culture": "culture", "history": "culture", "art": "culture", "beach": "relax", "nature": "nature", "nightlife": "nightlife", "shopping": "budget",
    "food": "relax", "religion": "culture", "luxury": "budget", "budget": "budget", "romance": "relax", "music": "culture",
}
PREFERENCES = ["budget", "culture", "nature", "nightlife", "relax", "adventure"]
NO_TAG, NO_PREFERENCE = 0.3, 0.5
CROWD_PENALTY = {"low": 0.0, "medium": 0.15, "high": 0.35}


def crowding_level(z: Column) -> Column:
    """low up to -0.4, medium up to 0.4, high above; null stays null."""
    return F.when(z <= -0.4, "low").when(z <= 0.4, "medium").when(z > 0.4, "high")


def crowd_penalty(level: Column) -> Column:
    return F.coalesce(*(F.when(level == k, F.lit(v)) for k, v in CROWD_PENALTY.items()))


def tag_affinity(preferences: Column, tags: Column) -> Column:
    """Mean preference over the tags that stand for one; 0.3 for a missing preference and if no tag does."""
    pairs = F.create_map(*(F.lit(x) for kv in TAG_PREFERENCE.items() for x in kv))
    known = F.filter(tags, lambda t: pairs[t].isNotNull())
    values = F.transform(known, lambda t: F.coalesce(preferences[pairs[t]], F.lit(NO_TAG)))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(F.lit(NO_TAG))


def budget_fit(level: Column, budget: Column) -> Column:
    return F.lit(1.0) - F.abs(level - (F.coalesce(budget, F.lit(NO_PREFERENCE)) * 2 + 1)) / F.lit(2.0)


def destination_score(affinity: Column, fit: Column, penalty: Column) -> Column:
    return F.lit(0.5) * affinity + F.lit(0.3) * fit - penalty


def fame(views: Column, links: Column) -> Column:
    return F.lit(0.6) * F.log1p(F.coalesce(views, F.lit(0)).cast("double")) + F.lit(0.8) * F.log1p(F.coalesce(links, F.lit(0)).cast("double"))


def round_half_even(x: Column, digits: int) -> Column:
    """x to so many digits as its binary value rounds: exact ties go to the even digit.

    The product with 10^digits is kept with its rounding error (Dekker's split),
    so 0.155, which lies a little under its decimal, becomes 0.15. For |x| under
    2^53 / 10^digits.
    """
    scale = float(10**digits)
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    product = x * F.lit(scale)
    error = (high * F.lit(scale) - product) + (x - high) * F.lit(scale)
    whole = F.floor(product).cast("double")
    over = (product - whole - F.lit(0.5)) + error
    up = F.when((over > 0) | ((over == 0) & (whole % 2 != 0)), F.lit(1.0)).otherwise(F.lit(0.0))
    return (whole + up) / F.lit(scale)


def popularity_of_share(share: Column) -> Column:
    """A within-city percentile on the scale 2.5 to 5; 4 where the city has no scores."""
    return F.coalesce(round_half_even(F.lit(2.5) + F.lit(2.5) * share, 2), F.lit(4.0))


def popularity_of_links(links: Column) -> Column:
    score = F.least(F.lit(4.9), F.lit(3.9) + F.lit(0.15) * F.log1p(links.cast("double")))
    return F.when(F.coalesce(links, F.lit(0)) > 0, round_half_even(score, 1)).otherwise(F.lit(4.0))
