"""Incident table derived from the driver tables.

The reference works on one wide table of timestamped, geolocated incidents.
The test data has no such table, so we derive one from
``events ⋈ customer ⋈ nation``: one incident per event. The derivation is a
single SQL text that Spark runs over DataFrames and that the DuckDB oracle
embeds as a CTE, so both engines start from identical rows. Every value is
integer arithmetic on the keys (no randomness), nulls and bad rows appear at
fixed rates so that the cleaning rules have work to do, and a 2 % slice of
events shares its ID with the previous event so that de-duplication matters.

Scale: ``events`` is the fact table. ``nation`` (25 rows by definition) is
broadcast; ``customer`` grows with the data and is left to the planner
(broadcast below ``spark.sql.autoBroadcastJoinThreshold`` by size estimate,
otherwise a shuffled join; AQE splits a hot ``user_id`` partition).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.tables import load_table

# Columns of the raw incident table, in order (the reference's raw schema
# plus ``_order``, the position of the source row, used to pick duplicates).
MEASURES = ["Distance(mi)", "Temperature(F)", "Humidity(%)", "Pressure(in)",
            "Visibility(mi)", "Wind_Speed(mph)", "Precipitation(in)"]
ROAD_FLAGS = ["Amenity", "Bump", "Crossing", "Give_Way", "Junction", "No_Exit",
              "Railway", "Roundabout", "Station", "Stop", "Traffic_Calming",
              "Traffic_Signal", "Turning_Loop"]

_SQL = """
SELECT /*+ BROADCAST(n) */
  ev.event_id AS _order,
  'A-' || CAST(CASE WHEN ev.event_id % 50 = 1 THEN ev.event_id - 1 ELSE ev.event_id END AS STRING) AS ID,
  CASE ev.event_id % 3 WHEN 0 THEN 'Source1' WHEN 1 THEN 'Source2' ELSE 'Source3' END AS Source,
  CASE WHEN ev.event_id % 97 = 0 THEN 0
       ELSE CASE ev.event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 2
                               WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END END AS Severity,
  ev.ts AS Start_Time,
  ev.ts + INTERVAL '1' SECOND * (CASE WHEN ev.event_id % 89 = 0 THEN -300
                                      WHEN ev.event_id % 83 = 0 THEN 100000
                                      ELSE CAST(round(ev.value * 60) AS BIGINT) END) AS End_Time,
  CASE WHEN ev.event_id % 101 = 7 THEN CAST(0 AS DOUBLE)
       ELSE 24.5 + CAST(ev.event_id * 37 % 2500 AS DOUBLE) / 100 END AS Start_Lat,
  -124.5 + CAST((ev.user_id * 53 + ev.event_id) % 5800 AS DOUBLE) / 100 AS Start_Lng,
  CASE WHEN ev.event_id % 5 >= 3 THEN 24.5 + CAST(ev.event_id * 37 % 2500 AS DOUBLE) / 100 END AS End_Lat,
  CASE WHEN ev.event_id % 5 >= 3 THEN -124.5 + CAST((ev.user_id * 53 + ev.event_id) % 5800 AS DOUBLE) / 100 END AS End_Lng,
  ev.value / 100 + CASE WHEN ev.event_id % 97 = 5 THEN 40 ELSE 0 END AS «Distance(mi)»,
  'Incident ' || ev.event_type AS Description,
  CASE ev.event_id % 4 WHEN 0 THEN ' main st ' WHEN 1 THEN 'I-95 N' WHEN 2 THEN 'o''brien ave' END AS Street,
  CASE ev.user_id % 4 WHEN 0 THEN '  ' || lower(c.c_mktsegment) || ' city'
                      WHEN 1 THEN 'st-louis ' || lower(c.c_mktsegment)
                      WHEN 2 THEN 'o''brien ' || upper(c.c_mktsegment)
                      ELSE '5th ' || c.c_mktsegment END AS City,
  CASE WHEN ev.event_id % 4 = 0 THEN 'county ' || CAST(ev.user_id % 10 AS STRING) END AS County,
  n.n_name AS State,
  lpad(CAST(ev.user_id % 100000 AS STRING), 5, '0') AS Zipcode,
  'US' AS Country,
  CASE n.n_regionkey WHEN 0 THEN 'US/Eastern' WHEN 1 THEN 'US/Central'
                     WHEN 2 THEN 'US/Mountain' WHEN 3 THEN 'US/Pacific' END AS Timezone,
  'KA' || CAST(c.c_nationkey AS STRING) AS Airport_Code,
  ev.ts AS Weather_Timestamp,
  CASE WHEN ev.event_id % 7 = 0 THEN NULL
       WHEN ev.event_type = 'error' THEN CAST(ev.event_id * 13 % 400 AS DOUBLE) / 10 - 10
       ELSE CAST(ev.event_id * 13 % 1150 AS DOUBLE) / 10 - 10 END AS «Temperature(F)»,
  CASE WHEN ev.event_id % 5 = 0 THEN CAST(ev.event_id * 13 % 1150 AS DOUBLE) / 10 - 15 END AS «Wind_Chill(F)»,
  CAST(ev.event_id * 17 % 101 AS DOUBLE) AS «Humidity(%)»,
  CASE WHEN ev.event_id % 211 = 0 THEN CAST(5 AS DOUBLE)
       ELSE 28 + CAST(ev.event_id % 300 AS DOUBLE) / 100 END AS «Pressure(in)»,
  CASE WHEN ev.event_id % 11 = 0 THEN NULL
       WHEN ev.event_type = 'error' THEN CAST(ev.event_id * 3 % 7 AS DOUBLE) / 2
       ELSE CAST(ev.event_id * 3 % 21 AS DOUBLE) / 2 END AS «Visibility(mi)»,
  CASE ev.event_id % 5 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'E' WHEN 3 THEN 'W' ELSE 'CALM' END AS Wind_Direction,
  CAST((ev.user_id * 7 + ev.event_id) % 45 AS DOUBLE) AS «Wind_Speed(mph)»,
  CASE WHEN ev.event_id % 13 = 0 THEN NULL ELSE CAST(ev.event_id % 5 AS DOUBLE) / 20 END AS «Precipitation(in)»,
  CASE ev.event_id % 16 WHEN 0 THEN 'Fair' WHEN 1 THEN 'Clear' WHEN 2 THEN 'Partly Cloudy'
       WHEN 3 THEN 'mostly cloudy' WHEN 4 THEN 'Overcast' WHEN 5 THEN 'Light Rain'
       WHEN 6 THEN 'Heavy Snow with Thunder' WHEN 7 THEN 'Fog' WHEN 8 THEN 'Haze'
       WHEN 9 THEN ' light drizzle ' WHEN 10 THEN 'Thunderstorm' WHEN 11 THEN 'Wintry Mix'
       WHEN 12 THEN 'Smoke' WHEN 13 THEN 'N/A Precipitation' WHEN 14 THEN 'Fair / Windy' END AS Weather_Condition,
  ev.event_id % 17 = 0 AS Amenity,
  ev.event_id % 41 = 0 AS Bump,
  ev.event_id % 5 = 2 AS Crossing,
  ev.event_id % 37 = 0 AS Give_Way,
  (ev.event_id % 3 = 0 OR ev.event_type = 'error') AS Junction,
  ev.event_id % 43 = 0 AS No_Exit,
  ev.event_id % 29 = 0 AS Railway,
  FALSE AS Roundabout,
  CASE WHEN ev.event_id % 19 = 0 THEN NULL ELSE ev.event_id % 23 = 0 END AS Station,
  ev.user_id % 6 = 0 AS Stop,
  ev.event_id % 47 = 0 AS Traffic_Calming,
  ev.event_id % 4 = 1 AS Traffic_Signal,
  FALSE AS Turning_Loop,
  CASE WHEN EXTRACT(HOUR FROM ev.ts) BETWEEN 6 AND 17 THEN 'Day' ELSE 'Night' END AS Sunrise_Sunset,
  CASE WHEN EXTRACT(HOUR FROM ev.ts) BETWEEN 6 AND 18 THEN 'Day' ELSE 'Night' END AS Civil_Twilight,
  CASE WHEN EXTRACT(HOUR FROM ev.ts) BETWEEN 5 AND 18 THEN 'Day' ELSE 'Night' END AS Nautical_Twilight,
  CASE WHEN EXTRACT(HOUR FROM ev.ts) BETWEEN 5 AND 19 THEN 'Day' ELSE 'Night' END AS Astronomical_Twilight
FROM {events} ev
LEFT JOIN {customer} c ON ev.user_id = c.c_custkey
LEFT JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""


def incidents_sql(dialect: str = "spark") -> str:
    """The derivation text for ``dialect`` 'spark' (``{events}`` placeholders
    bound to DataFrames) or 'duckdb' (plain view names)."""
    if dialect == "spark":
        return _SQL.replace("«", "`").replace("»", "`")
    text = _SQL.replace("«", '"').replace("»", '"')
    return text.format(events="events", customer="customer", nation="nation")


TABLES = ["events", "customer", "nation"]


def incidents(spark: SparkSession, sf_dir: str, deal: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Raw incident table (lazy); ``deal`` may deal the narrow event rows to other partitions first."""
    tables = {t: load_table(spark, sf_dir, t) for t in TABLES}
    tables["events"] = deal(tables["events"].select("event_id", "ts", "user_id", "event_type", "value"))
    return spark.sql(incidents_sql("spark"), **tables)
