"""DuckDB texts of the stage tables, written independently of the Spark code.

``RAW`` is the shared derivation; ``CLEANED`` and ``PROCESSED`` restate the
cleaning and feature rules in plain SQL (window de-duplication, scalar
quantile sub-queries, CASE chains) so that the oracle checks the Spark
implementation rather than repeating it.
"""

from __future__ import annotations

from quarry.sources.incidents import incidents_sql

CAP = ["Distance(mi)", "Temperature(F)", "Humidity(%)", "Pressure(in)",
       "Visibility(mi)", "Wind_Speed(mph)", "Precipitation(in)"]
MEDIAN = ["Temperature(F)", "Visibility(mi)", "Precipitation(in)"]  # numeric columns with NULLs
MODE = ["Street", "Timezone", "Weather_Condition"]                  # text columns with NULLs
DROPPED = ["End_Lat", "End_Lng", "County", "Wind_Chill(F)"]           # > 50 % missing
TITLE = ["City", "Street", "Weather_Condition"]
FLAGS = ["Amenity", "Bump", "Crossing", "Give_Way", "Junction", "No_Exit", "Railway",
         "Roundabout", "Station", "Stop", "Traffic_Calming", "Traffic_Signal", "Turning_Loop"]
ENCODED = ["State", "Timezone", "Wind_Direction", "Sunrise_Sunset", "Civil_Twilight",
           "Nautical_Twilight", "Astronomical_Twilight", "Source", "weather_category"]


def q(name: str) -> str:
    return '"' + name + '"'


def _title(expr: str) -> str:
    return ("array_to_string(list_transform(regexp_extract_all(trim(" + expr + "), '(\\p{L}+|[^\\p{L}]+)'), "
            "lambda t: upper(t[1]) || lower(t[2:])), '')")


def _cleaned() -> str:
    stats = []
    for i, c in enumerate(CAP):
        stats.append(f"quantile_cont({q(c)}, 0.25) AS q1_{i}, quantile_cont({q(c)}, 0.75) AS q3_{i}")
    for i, c in enumerate(MEDIAN):
        stats.append(f"quantile_cont({q(c)}, 0.5) AS med_{i}")
    modes = [f"(SELECT {q(c)} FROM f WHERE {q(c)} IS NOT NULL GROUP BY {q(c)} "
             f"ORDER BY count(*) DESC, {q(c)} LIMIT 1) AS mode_{i}" for i, c in enumerate(MODE)]
    repl = []
    for i, c in enumerate(CAP):
        lo = f"(s.q1_{i} - 3.0 * (s.q3_{i} - s.q1_{i}))"
        hi = f"(s.q3_{i} + 3.0 * (s.q3_{i} - s.q1_{i}))"
        capped = f"CASE WHEN f.{q(c)} IS NULL THEN NULL ELSE least(greatest(f.{q(c)}, {lo}), {hi}) END"
        if c in MEDIAN:
            capped = f"coalesce({capped}, s.med_{MEDIAN.index(c)})"
        repl.append(f"{capped} AS {q(c)}")
    for i, c in enumerate(MODE):
        v = f"coalesce(f.{q(c)}, s.mode_{i})"
        repl.append(f"{_title(v) if c in TITLE else v} AS {q(c)}")
    for c in TITLE:
        if c not in MODE:
            repl.append(f"{_title('f.' + q(c))} AS {q(c)}")
    for c in FLAGS:
        repl.append(f"coalesce(f.{q(c)}, false) AS {q(c)}")
    excl = ", ".join(q(c) for c in ["_order"] + DROPPED)
    return f"""
raw AS ({incidents_sql('duckdb')}),
dd AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY ID ORDER BY _order) AS rn FROM raw) WHERE rn = 1),
f AS (SELECT * EXCLUDE ({excl}) FROM dd
  WHERE Start_Lat BETWEEN 24 AND 50 AND Start_Lng BETWEEN -125 AND -66 AND Severity BETWEEN 1 AND 4),
s AS (SELECT {", ".join(stats)}, {", ".join(modes)} FROM f),
cleaned AS (SELECT f.* REPLACE ({", ".join(repl)}) FROM f, s)"""


def _weather_category(expr: str) -> str:
    groups = [("Snow/Ice", "snow|sleet|ice|blizzard|wintry"),
              ("Rain/Storm", "rain|drizzle|shower|thunder|storm"),
              ("Fog/Haze", "fog|mist|haze|smoke|dust"),
              ("Clear", "clear|fair|sunny"),
              ("Cloudy", "cloud|overcast|partly")]
    whens = " ".join(f"WHEN regexp_matches(lower({expr}), '{p}') THEN '{g}'" for g, p in groups)
    return f"CASE {whens} ELSE 'Other' END"


def _processed() -> str:
    score = (
        "least(greatest("
        "CAST(coalesce(\"Temperature(F)\" < 32 OR \"Temperature(F)\" > 95, false) AS DOUBLE)"
        " + 2 * CAST(coalesce(\"Visibility(mi)\" < 1.0, false) AS DOUBLE)"
        " + CAST(coalesce(\"Visibility(mi)\" BETWEEN 1.0 AND 3.0, false) AS DOUBLE)"
        " + CAST(coalesce(\"Wind_Speed(mph)\" > 30, false) AS DOUBLE)"
        " + CAST(coalesce(\"Precipitation(in)\" > 0.1, false) AS DOUBLE), 0), 5)")
    road = " + ".join(f"CAST(coalesce({q(c)}, false) AS INTEGER)" for c in FLAGS)
    enc = ", ".join(
        f"CAST(dense_rank() OVER (ORDER BY coalesce({q(c)}, 'nan')) - 1 AS INTEGER) AS {q(c + '_enc')}"
        for c in ENCODED)
    return f"""{_cleaned()},
f1 AS (SELECT *,
  CAST(hour(Start_Time) AS INTEGER) AS hour,
  CAST(isodow(Start_Time) - 1 AS INTEGER) AS day_of_week,
  CAST(month(Start_Time) AS INTEGER) AS month,
  CAST(year(Start_Time) AS INTEGER) AS year,
  least(greatest(date_diff('microsecond', Start_Time, End_Time) / CAST(60000000 AS DOUBLE), 0), 1440) AS duration_min,
  {score} AS weather_severity_score,
  {_weather_category('Weather_Condition')} AS weather_category,
  CAST({road} AS INTEGER) AS road_feature_count,
  CAST(Severity >= 3 AS INTEGER) AS target
  FROM cleaned),
f2 AS (SELECT *,
  CAST(day_of_week >= 5 AS INTEGER) AS is_weekend,
  CAST(hour IN (7, 8, 9, 16, 17, 18) AS INTEGER) AS is_rush_hour,
  CAST(hour < 6 OR hour >= 21 AS INTEGER) AS is_night,
  CAST(floor((month % 12) / 3) AS INTEGER) AS season
  FROM f1),
processed AS (SELECT *, {enc} FROM f2)"""


RAW_CTE = "WITH raw AS (" + incidents_sql("duckdb") + ")\n"
CLEANED_CTE = "WITH " + _cleaned().lstrip() + "\n"
PROCESSED_CTE = "WITH " + _processed().lstrip() + "\n"


def _splice(cte: str, select: str) -> str:
    """Append ``select``; its own leading WITH list joins the stage CTEs."""
    body = select.lstrip()
    if body[:4].upper() == "WITH":
        return cte.rstrip() + ",\n" + body[4:].lstrip()
    return cte + body


def over_raw(select: str) -> str:
    return _splice(RAW_CTE, select)


def over_cleaned(select: str) -> str:
    return _splice(CLEANED_CTE, select)


def over_processed(select: str) -> str:
    return _splice(PROCESSED_CTE, select)


# Raw incident columns in order (the derivation's output schema).
RAW_COLUMNS = [
    "_order", "ID", "Source", "Severity", "Start_Time", "End_Time", "Start_Lat", "Start_Lng", "End_Lat",
    "End_Lng", "Distance(mi)", "Description", "Street", "City", "County", "State", "Zipcode", "Country",
    "Timezone", "Airport_Code", "Weather_Timestamp", "Temperature(F)", "Wind_Chill(F)", "Humidity(%)",
    "Pressure(in)", "Visibility(mi)", "Wind_Direction", "Wind_Speed(mph)", "Precipitation(in)",
    "Weather_Condition", "Amenity", "Bump", "Crossing", "Give_Way", "Junction", "No_Exit", "Railway",
    "Roundabout", "Station", "Stop", "Traffic_Calming", "Traffic_Signal", "Turning_Loop", "Sunrise_Sunset",
    "Civil_Twilight", "Nautical_Twilight", "Astronomical_Twilight"]
