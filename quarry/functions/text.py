"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A run of letters or a run of anything else; title case applies per letter run.
_RUNS = r"(\p{L}+|[^\p{L}]+)"


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every letter run, lower-case the rest.

    Same as Python's ``str.title``: the letter after an apostrophe, hyphen or
    digit starts a new word ("o'brien 5th" → "O'Brien 5Th"), which plain
    ``initcap`` does not do. NULL stays NULL.
    """
    runs = F.regexp_extract_all(c, F.lit(_RUNS), 1)
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def standardise(c: Column) -> Column:
    """Trim, then title case."""
    return title_case(F.trim(c))


def city_state(city: Column, state: Column) -> Column:
    return F.concat_ws(", ", city, state)


def last_part(c: Column, separator: str = ", ") -> Column:
    """What follows the last separator (all of it, without one)."""
    return F.substring_index(c, separator, -1)


def format_int(c: Column) -> Column:
    """Whole numbers with thousands marks."""
    return F.format_number(c, 0)


def format_pct(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", c)


def title_of(c: Column) -> Column:
    """An identifier with underscores as a title."""
    return title_case(F.replace(c, F.lit("_"), F.lit(" ")))
