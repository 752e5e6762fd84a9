"""Report tables and facts, formatted texts, and the fixed incident table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.functions.stats import qcol
from quarry.operators import charts, clean, quality
from quarry.plans.catalog import register
from quarry.plans.oracle_base import CLEANED_CTE, over_cleaned, over_processed, over_raw
from quarry.plans.stages import cleaned, processed, raw
from quarry.session import stage_path
from quarry.sources import ingest, sinks
from quarry.sources.versions import VersionedTable


@register("report_tables", over_processed("""
SELECT 'severity' AS tab, CAST(Severity AS VARCHAR) AS item, format('{:,}', count(*)) AS accidents, format('{:.2f}%', 100.0 * count(*) / (SELECT count(*) FROM processed)) AS share FROM processed GROUP BY Severity
UNION ALL SELECT 'years', CAST(year AS VARCHAR), format('{:,}', count(*)), NULL FROM processed GROUP BY year
UNION ALL (SELECT 'top_states', State, format('{:,}', count(*)), NULL FROM processed GROUP BY State ORDER BY count(*) DESC, State LIMIT 10)
UNION ALL (SELECT 'top_cities', City || ', ' || State, format('{:,}', count(*)), NULL FROM processed WHERE City IS NOT NULL AND State IS NOT NULL GROUP BY City, State ORDER BY count(*) DESC, City, State LIMIT 10)
UNION ALL (SELECT 'top_weather', Weather_Condition, format('{:,}', count(*)), NULL FROM processed GROUP BY Weather_Condition ORDER BY count(*) DESC, Weather_Condition LIMIT 10)
UNION ALL SELECT 'weather_rates', weather_category, NULL, format('{:.2f}%', 100.0 * avg(target)) FROM processed GROUP BY weather_category"""))
def report_tables(spark, sf_dir):
    """H5: the report's tables in one long form, with formatted counts and shares."""
    t = charts.report_tables(processed(spark, sf_dir))
    none = F.lit(None).cast("string")
    item = {"severity": F.col("Severity").cast("string"), "years": F.col("year").cast("string"), "top_states": F.col("State"),
            "top_cities": F.col("city_state"), "top_weather": F.col("Weather_Condition"), "weather_rates": F.col("weather_category")}
    out = None
    for name, df in t.items():
        share = text.format_pct(F.col("share") * 100) if name == "severity" else text.format_pct(F.col("high_severity_rate")) if name == "weather_rates" else none
        count = none if name == "weather_rates" else text.format_int(F.col("count"))
        rows = df.select(F.lit(name).alias("tab"), item[name].alias("item"), count.alias("accidents"), share.alias("share"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("state_totals", over_processed("""
WITH c AS (SELECT City || ', ' || State AS city_state, count(*) AS n FROM processed WHERE City IS NOT NULL AND State IS NOT NULL GROUP BY City, State)
SELECT string_split(city_state, ', ')[-1] AS state, CAST(sum(n) AS BIGINT) AS count FROM c GROUP BY 1 ORDER BY count DESC, state LIMIT 15"""))
def state_totals(spark, sf_dir):
    """T4: totals by the state cut from "city, state" labels, the 15 largest."""
    c = processed(spark, sf_dir).where("City IS NOT NULL AND State IS NOT NULL").groupBy(text.city_state(F.col("City"), F.col("State")).alias("label")) \
        .agg(F.count(F.lit(1)).alias("n"))
    out = c.groupBy(text.last_part(F.col("label")).alias("state")).agg(F.sum("n").alias("count"))
    return out.orderBy(F.desc("count"), "state").limit(15)


@register("type_counts", "SELECT CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'BOOLEAN' THEN 'boolean' "
          "WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' ELSE 'timestamp_ntz' END AS type, count(*) AS n_columns "
          f"FROM (DESCRIBE {CLEANED_CTE} SELECT * FROM cleaned) GROUP BY 1")
def type_counts(spark, sf_dir):
    """Q3: columns of the cleaned table by type."""
    return quality.type_count_table(cleaned(spark, sf_dir))


@register("preview", over_raw("SELECT _order, ID, Severity, Start_Time, City, State FROM raw ORDER BY _order LIMIT 3"))
def preview(spark, sf_dir):
    """Q10: the first three rows."""
    return raw(spark, sf_dir).select("_order", "ID", "Severity", "Start_Time", "City", "State").orderBy("_order").limit(3)


@register("distinct_states", over_cleaned("SELECT DISTINCT State FROM cleaned WHERE State IS NOT NULL"))
def distinct_states(spark, sf_dir):
    """Q10: the states present."""
    return cleaned(spark, sf_dir).select("State").where("State IS NOT NULL").distinct()


@register("map_hover", over_processed(
    "SELECT ID, Start_Lat, Start_Lng, Severity, City, State, Weather_Condition FROM processed "
    "WHERE Start_Lat IS NOT NULL AND Start_Lng IS NOT NULL ORDER BY md5('42:' || ID), ID LIMIT 2000"))
def map_hover(spark, sf_dir):
    """H3: a 2,000-point sample with the column that the map shows on hover."""
    return charts.map_points(processed(spark, sf_dir), 2000, cols=("Start_Lat", "Start_Lng", "Severity", "City", "State", "Weather_Condition"))


_PARTIAL = ["Temperature(F)", "Visibility(mi)", "Station", "Timezone"]


@register("complete_cases", over_raw("SELECT ID, _order FROM raw WHERE " + " AND ".join(f'"{c}" IS NOT NULL' for c in _PARTIAL)))
def complete_cases(spark, sf_dir):
    """Rows without a missing value in four columns."""
    return clean.complete_cases(raw(spark, sf_dir), _PARTIAL).select("ID", "_order")


@register("zero_fill", over_raw('SELECT _order, round(coalesce("Precipitation(in)", 0), 6) AS precipitation, round(coalesce("Wind_Chill(F)", 0), 6) AS wind_chill FROM raw'))
def zero_fill(spark, sf_dir):
    """Missing numbers as zero."""
    out = clean.zero_fill(raw(spark, sf_dir), ["Precipitation(in)", "Wind_Chill(F)"])
    return out.select("_order", F.round(qcol("Precipitation(in)"), 6).alias("precipitation"), F.round(qcol("Wind_Chill(F)"), 6).alias("wind_chill"))


@register("incident_table", over_cleaned("""
SELECT row_number() OVER (ORDER BY ID) AS id, ID AS accident_id, CAST(Severity AS INTEGER) AS severity, Start_Time AS start_time, round(Start_Lat, 6) AS start_lat,
  round(Start_Lng, 6) AS start_lng, City AS city, State AS state, CAST(NULL AS VARCHAR) AS county, Zipcode AS zipcode, round("Temperature(F)", 6) AS temperature_f,
  round("Humidity(%)", 6) AS humidity_pct, round("Visibility(mi)", 6) AS visibility_mi, round("Wind_Speed(mph)", 6) AS wind_speed_mph,
  round("Precipitation(in)", 6) AS precipitation_in, Weather_Condition AS weather_condition, round("Distance(mi)", 6) AS distance_mi,
  Sunrise_Sunset AS sunrise_sunset, Junction AS junction, Traffic_Signal AS traffic_signal, Crossing AS crossing, Description AS description
FROM cleaned"""))
def incident_table(spark, sf_dir):
    """The fixed incident table, without the time of its making; ids by rank of the incident's own."""
    out = sinks.incident_rows(cleaned(spark, sf_dir)).drop("created_at")
    doubles = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    return out.withColumns({c: F.round(c, 6) for c in doubles}).withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))


_SUMS = ["Severity", "hour", "year", "road_feature_count", "State_enc", "target", "duration_min", "Temperature(F)"]
_NARROWED = {"Severity": "tinyint", "hour": "tinyint", "year": "smallint", "road_feature_count": "tinyint", "State_enc": "tinyint", "target": "tinyint",
             "duration_min": "float", "Temperature(F)": "float"}


@register("narrowed_table", over_processed("\nUNION ALL ".join(
    f"SELECT '{c}' AS column, '{t}' AS type, " + (f'CAST(sum("{c}") AS DOUBLE)' if t != "float" else f'round(avg("{c}"), 2)') + " AS told, count(*) AS n_rows, 1 AS versions FROM processed"
    for c, t in _NARROWED.items())))
def narrowed_table(spark, sf_dir):
    """The processed table rewritten with narrow types beside its old version, which is removed after."""
    table = VersionedTable(spark, stage_path(spark, "versions", uuid.uuid4().hex))
    table.write(processed(spark, sf_dir).select("ID", *[qcol(c) for c in _SUMS]))
    plan = {r["column"]: r["narrowed_type"] for r in ingest.narrowed_types(table.read(), _SUMS).collect()}
    table.rewrite(lambda df: ingest.narrow(df, plan))
    table.remove_old()
    now = table.read()
    types = dict(now.dtypes)
    sums = [F.sum(qcol(c).cast("long")).cast("double") if types[c] != "float" else F.round(F.avg(qcol(c).cast("double")), 2) for c in _SUMS]
    row = now.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*sums).alias("told"))
    facts = F.arrays_zip(F.array(*[F.lit(c) for c in _SUMS]).alias("column"), F.array(*[F.lit(types[c]) for c in _SUMS]).alias("type"), F.col("told"))
    return row.select("n_rows", F.explode(facts).alias("f")).select("f.column", "f.type", "f.told", "n_rows", F.lit(len(table.pointers()) - 1).alias("versions"))


@register("model_finding")
def model_finding(spark, sf_dir):
    """H6: the best model by stored test metrics, with its AUC as text."""
    from quarry.plans.model_queries import test_metrics
    best = test_metrics(spark, sf_dir).orderBy(F.col("test_auc").desc(), F.col("test_ap").desc(), "model").limit(1)
    return best.select(F.lit("best_model").alias("finding"), F.concat(text.title_of(F.col("model")), F.lit(" (test AUC "), F.format_string("%.4f", "test_auc"), F.lit(")")).alias("value"))
