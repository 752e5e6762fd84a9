"""Weather and road-infrastructure expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword groups of the weather category, tested in this order;
# the first group that matches (case-insensitive substring) wins.
WEATHER_GROUPS = [
    ("Snow/Ice", ["snow", "sleet", "ice", "blizzard", "wintry"]),
    ("Rain/Storm", ["rain", "drizzle", "shower", "thunder", "storm"]),
    ("Fog/Haze", ["fog", "mist", "haze", "smoke", "dust"]),
    ("Clear", ["clear", "fair", "sunny"]),
    ("Cloudy", ["cloud", "overcast", "partly"]),
]
WEATHER_OTHER = "Other"
WEATHER_CATEGORIES = [g for g, _ in WEATHER_GROUPS] + [WEATHER_OTHER]

# Thresholds of the weather severity score (0–5).
FREEZING_F, HOT_F = 32, 95
LOW_VISIBILITY, POOR_VISIBILITY = 1.0, 3.0
WINDY_MPH = 30
WET_IN = 0.1
MAX_SCORE = 5.0


def _flag(pred: Column) -> Column:
    """Comparison with a missing value counts as false."""
    return F.coalesce(pred, F.lit(False)).cast("double")


def weather_score(columns: list[str]) -> Column:
    """Composite 0–5 score; a column that is absent contributes nothing."""
    present = set(columns)
    terms = [F.lit(0.0)]
    if "Temperature(F)" in present:
        t = F.col("`Temperature(F)`")
        terms.append(_flag((t < FREEZING_F) | (t > HOT_F)))
    if "Visibility(mi)" in present:
        v = F.col("`Visibility(mi)`")
        terms.append(_flag(v < LOW_VISIBILITY) * 2)
        terms.append(_flag(v.between(LOW_VISIBILITY, POOR_VISIBILITY)))
    if "Wind_Speed(mph)" in present:
        terms.append(_flag(F.col("`Wind_Speed(mph)`") > WINDY_MPH))
    if "Precipitation(in)" in present:
        terms.append(_flag(F.col("`Precipitation(in)`") > WET_IN))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(MAX_SCORE))


def weather_category(c: Column) -> Column:
    low = F.lower(c)
    expr = None
    for name, words in WEATHER_GROUPS:
        cond = low.rlike("|".join(words))
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise(WEATHER_OTHER)


def road_feature_count(columns: list[str], flags: list[str]) -> Column:
    present = [f for f in flags if f in set(columns)]
    if not present:
        return F.lit(0)
    total = None
    for f in present:
        term = F.coalesce(F.col(f).cast("boolean"), F.lit(False)).cast("int")
        total = term if total is None else total + term
    return total.cast("int")
