"""Source/sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions.stats import qcol
from quarry.plans.catalog import register
from quarry.plans.model_queries import _SPLIT
from quarry.plans.oracle_base import over_processed, over_raw
from quarry.plans.stages import processed_with_meta, raw
from quarry.session import stage_path
from quarry.sources import ingest, sinks

_CSV_TYPES = {"ID": "string", "Severity": "int", "Start_Time": "string", "End_Time": "string",
              "Start_Lat": "double", "Start_Lng": "double", "Distance(mi)": "double", "City": "string",
              "Temperature(F)": "double", "Junction": "string", "Station": "string"}


@register("csv_roundtrip", over_raw(
    "SELECT count(*) AS n_rows, count(DISTINCT ID) AS n_ids, CAST(sum(Severity) AS BIGINT) AS severity_sum, "
    "round(sum(Start_Lat), 6) AS lat_sum, round(sum(\"Temperature(F)\"), 6) AS temp_sum, "
    "count(*) FILTER (WHERE Junction) AS n_junction, count(Station) AS n_station, "
    "min(Start_Time) AS first_start, max(End_Time) AS last_end FROM raw"))
def csv_roundtrip(spark, sf_dir):
    """Raw incidents written as CSV and read back through the typed ingest."""
    path = stage_path(spark, "csv", f"raw-{uuid.uuid4().hex}")
    cols = list(_CSV_TYPES)
    ingest.write_csv(raw(spark, sf_dir).select(*[qcol(c) for c in cols]), path)
    df = ingest.read_csv_typed(spark, path, _CSV_TYPES, timestamps=["Start_Time", "End_Time"],
                               booleans=["Junction", "Station"])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ID").alias("n_ids"),
                  F.sum("Severity").cast("long").alias("severity_sum"),
                  F.round(F.sum("Start_Lat"), 6).alias("lat_sum"),
                  F.round(F.sum(qcol("Temperature(F)")), 6).alias("temp_sum"),
                  F.count_if("Junction").alias("n_junction"), F.count("Station").alias("n_station"),
                  F.min("Start_Time").cast("timestamp_ntz").alias("first_start"),
                  F.max("End_Time").cast("timestamp_ntz").alias("last_end"))


_LINE_TYPES = {"ID": "string", "Severity": "int", "Start_Lat": "double", "City": "string", "_order": "bigint"}


def _csv_lines(spark, sf_dir):
    """Raw incidents as CSV texts: by place, one in ten has a field too many, is short, or has cells that are no numbers."""
    c = F.col("_order") % 10
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.coalesce("City", F.lit("")), '"', '\\\\"'), F.lit('"'))
    lat = F.when(c == 7, F.lit("x")).otherwise(F.coalesce(F.col("Start_Lat").cast("string"), F.lit("")))
    severity = F.when(c == 7, F.lit("two")).otherwise(F.coalesce(F.col("Severity").cast("string"), F.lit("")))
    whole = F.concat_ws(",", "ID", severity, lat, quoted, F.col("_order").cast("string"))
    text = F.when(c == 3, F.concat(whole, F.lit(",EXTRA"))).when(c == 5, F.concat_ws(",", "ID", severity)).otherwise(whole)
    return raw(spark, sf_dir).select("_order", text.alias("value"))


_LINES_SQL = ("SELECT _order AS place, ID, CASE WHEN _order % 10 <> 7 THEN Severity END AS Severity, "
              "CASE WHEN _order % 10 NOT IN (5, 7) THEN round(Start_Lat, 6) END AS Start_Lat, "
              "CASE WHEN _order % 10 <> 5 THEN City END AS City, CASE WHEN _order % 10 <> 5 THEN _order END AS line FROM raw WHERE _order % 10 <> 3")


@register("csv_malformed", over_raw(f"SELECT ID, Severity, Start_Lat, City, line FROM ({_LINES_SQL})"))
def csv_malformed(spark, sf_dir):
    """CSV lines with a field too many (skipped), short ones (filled with NULL) and bad cells (NULL)."""
    path = stage_path(spark, "csv", f"lines-{uuid.uuid4().hex}")
    _csv_lines(spark, sf_dir).select("value").write.text(path)
    df = ingest.read_csv_typed(spark, path, _LINE_TYPES, header=False)
    return df.select("ID", "Severity", F.round("Start_Lat", 6).alias("Start_Lat"), "City", F.col("_order").alias("line"))


@register("csv_ordered", over_raw(
    f"SELECT ID, Severity, Start_Lat, City, line FROM (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY place) AS rn "
    f"FROM (SELECT * FROM ({_LINES_SQL}) ORDER BY place LIMIT 5000)) WHERE rn = 1"))
def csv_ordered(spark, sf_dir):
    """The first 5,000 good rows of many files in file order, and of each ID the first row."""
    from quarry.operators.clean import dedup
    path = stage_path(spark, "csv", f"files-{uuid.uuid4().hex}")
    _csv_lines(spark, sf_dir).repartitionByRange(7, "_order").sortWithinPartitions("_order").select("value").write.text(path)
    types = {("line" if c == "_order" else c): t for c, t in _LINE_TYPES.items()}
    df = ingest.read_csv_ordered(spark, path, types, first=5000, header=False)
    return dedup(df, "ID", "_order").select("ID", "Severity", F.round("Start_Lat", 6).alias("Start_Lat"), "City", "line")


_NARROW = ["Severity", "hour", "day_of_week", "year", "road_feature_count", "State_enc",
           "Distance(mi)", "Temperature(F)", "duration_min"]
_INTS = {"Severity", "hour", "day_of_week", "year", "road_feature_count", "State_enc"}


@register("narrow_types", over_processed("\nUNION ALL ".join(
    f"SELECT '{c}' AS column, CASE WHEN min(\"{c}\") >= -128 AND max(\"{c}\") <= 127 THEN 'tinyint' "
    f"WHEN min(\"{c}\") >= -32768 AND max(\"{c}\") <= 32767 THEN 'smallint' ELSE 'int' END AS narrowed_type "
    f"FROM processed" if c in _INTS else
    f"SELECT '{c}' AS column, 'float' AS narrowed_type FROM processed HAVING count(*) > 0" for c in _NARROW)))
def narrow_types(spark, sf_dir):
    """On-disk type narrowing plan."""
    df, _, _ = processed_with_meta(spark, sf_dir)
    return ingest.narrowed_types(df, _NARROW)


@register("prediction_log")
def prediction_log(spark, sf_dir):
    """Prediction log rows (features JSON, class, probability, model, time)."""
    from quarry.plans.model_queries import best_model
    from quarry.operators import ml
    name, model, feats, data = best_model(spark, sf_dir)
    scored = ml.score(model, data.where(F.col("split") == "test"))
    return sinks.prediction_log_rows(scored, feats, name)


_U42 = "CAST(('0x' || substr(md5('42:' || ID), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0"
_OPEN = ("Temperature(F)", "Visibility(mi)")


def _requests(df):
    """Rows as JSON request texts (``value``): by hashed id some with an hour of 99, some cut off, some without two fields."""
    from quarry.operators.features import REQUEST_FIELDS
    from quarry.operators.ml import unit_hash
    u = unit_hash(F.col("ID"))
    hour = F.when(u < 0.02, F.lit(99)).otherwise(F.col("hour").cast("int")).alias("hour")
    open_ = (u >= 0.04) & (u < 0.08)
    fields = [F.when(~open_, qcol(c)).alias(c) if c in _OPEN else qcol(c).cast(t).alias(c) for c, t in REQUEST_FIELDS.items() if c != "hour"]
    text = F.to_json(F.struct(hour, *fields))  # open fields are left out
    return df.select("ID", F.when((u >= 0.02) & (u < 0.04), F.substring(text, 1, 40)).otherwise(text).alias("value"))


def _stream(spark, sf_dir):
    """Test rows as JSON requests through the scoring stream; the last batch runs twice: (log, rejected, dead letters)."""
    from quarry.plans.model_queries import best_model
    from quarry.streaming.scoring import batch_writer, read_sink, scoring_stream
    name, model, feats, data = best_model(spark, sf_dir)
    run = uuid.uuid4().hex[:10]
    src, sink = stage_path(spark, "stream", run, "requests"), stage_path(spark, "stream", run, "sink")
    _requests(data.where(F.col("split") == "test")).select("value").write.text(src)
    q = scoring_stream(spark, src, {name: model}, name, feats, sink, stage_path(spark, "stream", run, "checkpoint"))
    q.awaitTermination()
    if q.lastProgress:  # replayed: its rows are the same, so the sinks stay as they are
        batch_writer({name: model}, name, feats, sink)(spark.read.text(src), q.lastProgress["batchId"])
    return read_sink(spark, sink)


@register("stream_scoring")
def stream_scoring(spark, sf_dir):
    """Requests scored by a Structured Streaming job (availableNow); the prediction log."""
    return _stream(spark, sf_dir)[0]


@register("stream_checks", over_processed(
    f"SELECT 'scored' AS outcome, count(*) AS requests, 42 AS min_keys, 42 AS max_keys FROM ({_SPLIT}) WHERE {_U42} >= 0.04 AND split = 'test'\n"
    f"UNION ALL SELECT 'rejected: hour', count(*), NULL, NULL FROM ({_SPLIT}) WHERE {_U42} < 0.02 AND split = 'test'\n"
    f"UNION ALL SELECT 'dead letter', count(*), NULL, NULL FROM ({_SPLIT}) WHERE {_U42} >= 0.02 AND {_U42} < 0.04 AND split = 'test'"))
def stream_checks(spark, sf_dir):
    """R1, what is determined: requests scored (and keys in their feature JSON), rejected by failed field, and unreadable, after a batch was replayed."""
    log, rejected, dead = _stream(spark, sf_dir)
    keys = F.size(F.json_object_keys("features"))
    none = [F.lit(None).cast("int").alias(c) for c in ("min_keys", "max_keys")]
    ok = log.agg(F.lit("scored").alias("outcome"), F.count(F.lit(1)).alias("requests"),
                 F.min(keys).alias("min_keys"), F.max(keys).alias("max_keys"))
    bad = rejected.groupBy(F.concat(F.lit("rejected: "), F.array_join("violations", ",")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("requests"), *none)
    lost = dead.agg(F.lit("dead letter").alias("outcome"), F.count(F.lit(1)).alias("requests"), *none)
    return ok.unionByName(bad).unionByName(lost)


_DEFAULTS = {"Distance(mi)": 0.5, "Temperature(F)": 55.0, "Humidity(%)": 70.0, "Visibility(mi)": 10.0, "Wind_Speed(mph)": 10.0}


@register("request_defaults", over_raw(
    "SELECT _order, " + ", ".join(f"coalesce(nullif(round(\"{c}\", 6), 0), {v}) AS \"{c}\"" for c, v in _DEFAULTS.items())
    + ", round(coalesce(\"Pressure(in)\", 29.9), 6) AS \"Pressure(in)\", round(coalesce(\"Precipitation(in)\", 0.0), 6) AS \"Precipitation(in)\", "
    "CAST(30.0 AS DOUBLE) AS duration_min, 0 AS road_feature_count, CAST(least("
    "coalesce(CAST(nullif(round(\"Temperature(F)\", 6), 0) < 32 OR nullif(round(\"Temperature(F)\", 6), 0) > 95 AS INTEGER), 0)"
    " + CASE WHEN nullif(round(\"Visibility(mi)\", 6), 0) < 1.0 THEN 2 WHEN nullif(round(\"Visibility(mi)\", 6), 0) <= 3.0 THEN 1 ELSE 0 END"
    " + coalesce(CAST(nullif(round(\"Wind_Speed(mph)\", 6), 0) > 30 AS INTEGER), 0)"
    " + coalesce(CAST(round(\"Precipitation(in)\", 6) > 0.1 AS INTEGER), 0), 5) AS DOUBLE) AS weather_severity_score FROM raw"))
def request_defaults(spark, sf_dir):
    """raw incidents as JSON requests, parsed, with weather score and defaults."""
    from quarry.operators.features import fill_defaults
    from quarry.streaming.scoring import parse_requests
    said = [*_DEFAULTS, "Pressure(in)", "Precipitation(in)"]
    lines = raw(spark, sf_dir).select(F.to_json(F.struct(F.col("_order").alias("year"), *[F.round(qcol(c), 6).alias(c) for c in said])).alias("value"))
    out = fill_defaults(parse_requests(lines))
    return out.select(F.col("year").cast("long").alias("_order"), *[qcol(c) for c in said], "duration_min", "road_feature_count",
                      F.col("weather_severity_score").cast("double").alias("weather_severity_score"))


def _meta_oracle() -> str:
    from quarry.plans.feature_queries import FEATURES
    from quarry.plans.oracle_base import ENCODED
    feats = "\nUNION ALL ".join(f"SELECT 'feature' AS kind, '' AS column, '{f}' AS name, {i} AS position"
                                for i, f in enumerate(FEATURES))
    classes = "\nUNION ALL ".join(
        f"SELECT DISTINCT 'class', '{c}', coalesce(\"{c}\", 'nan'), "
        f"CAST(dense_rank() OVER (ORDER BY coalesce(\"{c}\", 'nan')) - 1 AS INTEGER) FROM processed"
        for c in ENCODED)
    return over_processed(feats + "\nUNION ALL " + classes)


@register("feature_metadata", _meta_oracle())
def feature_metadata(spark, sf_dir):
    """Feature list and encoder classes written as JSON lines and read back."""
    _, classes, feats = processed_with_meta(spark, sf_dir)
    path = stage_path(spark, "metadata", f"features-{uuid.uuid4().hex}")
    return sinks.read_metadata(spark, sinks.write_metadata(feats, classes, path))
