"""Online scoring as a stream (R1): JSON requests → defaults and derived flags → validation → model → prediction log.

One read feeds three sinks: the prediction log, rejected requests (with their failed fields) and dead letters (texts that
are no request). Every micro-batch writes its rows to folders named by its batch id, and a batch that
runs again overwrites them, so a replay adds no row. Stateless, so no watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.stats import qcol
from quarry.operators.clean import align_features
from quarry.operators.features import REQUEST_FIELDS, fill_defaults, request_features
from quarry.operators.ml import score
from quarry.operators.quality import request_violations
from quarry.sources.sinks import PREDICTION_LOG_SCHEMA, prediction_log_rows

_BAD = "_malformed"
REQUEST_SCHEMA = T.StructType([*[T.StructField(n, t) for n, t in REQUEST_FIELDS.items()],
                               T.StructField("model_name", T.StringType()), T.StructField(_BAD, T.StringType())])


def parse_requests(lines: DataFrame) -> DataFrame:
    """Text rows (``value``) as request fields and ``request`` (the text). A text that is no JSON object or has
    a field of another type is in ``_malformed`` too; absent fields are NULL, unknown ones are ignored."""
    r = F.from_json("value", REQUEST_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    out = lines.select(F.col("value").alias("request"), r.alias("r")).select("request", "r.*")
    no_object = ~F.coalesce(F.startswith(F.trim("request"), F.lit("{")), F.lit(False))
    return out.withColumn(_BAD, F.when(no_object, F.coalesce("request", F.lit(""))).otherwise(F.col(_BAD)))


def checked_requests(lines: DataFrame, models: dict, default: str) -> DataFrame:
    """Text rows as requests with defaults and derived fields, and ``violations``, the failed fields. A request names its
    model or gets ``default``; an unknown name is a failed field. Texts that are no request are in ``_malformed``."""
    named = F.coalesce(F.nullif(F.col("model_name"), F.lit("")), F.lit(default))
    requests = parse_requests(lines).withColumn("model_name", named)
    checked = request_violations(request_features(fill_defaults(requests)))
    known = F.col("model_name").isin(list(models))
    return checked.withColumn("violations", F.when(known, F.col("violations")).otherwise(F.array_append("violations", F.lit("model_name"))))


def outcomes(checked: DataFrame, models: dict, features: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prediction log, rejected, dead letters) of checked requests."""
    dead = checked.where(qcol(_BAD).isNotNull()).select("request")
    checked = checked.where(qcol(_BAD).isNull()).drop(_BAD)
    rejected = checked.where(F.size("violations") > 0).select("request", "violations")
    valid = checked.where(F.size("violations") == 0)
    log = None
    for name, model in models.items():
        mine = align_features(valid.where(F.col("model_name") == name), features)
        rows = prediction_log_rows(score(model, mine), features, name)
        log = rows if log is None else log.unionByName(rows)
    return log, rejected, dead


def scored_batch(lines: DataFrame, models: dict, default: str, features: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prediction log, rejected, dead letters) of text rows."""
    return outcomes(checked_requests(lines, models, default), models, features)


def batch_writer(models: dict, default: str, features: list[str], sink: str) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: writes a batch's rows to ``sink``/log, /rejected and /dead.

    Checked requests are kept, not the texts: a filter on what was parsed would else be moved below the parsing, and parse each
    text again for every field that it looks at."""
    def write(lines: DataFrame, batch_id: int) -> None:
        checked = checked_requests(lines, models, default).persist()
        try:
            for rows, name in zip(outcomes(checked, models, features), ("log", "rejected", "dead"), strict=True):
                rows.write.mode("overwrite").parquet(f"{sink}/{name}/batch_id={batch_id}")
        finally:
            checked.unpersist()
    return write


def scoring_stream(spark: SparkSession, source: str, models: dict, default: str, features: list[str], sink: str, checkpoint: str,
                   available_now: bool = True):
    """Start the stream over text files of one JSON request a line; returns its StreamingQuery."""
    w = spark.readStream.text(source).writeStream.foreachBatch(batch_writer(models, default, features, sink)) \
        .option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")).start()


def read_sink(spark: SparkSession, sink: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log, rejected, dead letters) that were written so far."""
    log = spark.read.schema(PREDICTION_LOG_SCHEMA).parquet(f"{sink}/log")
    return (log, spark.read.schema("request string, violations array<string>").parquet(f"{sink}/rejected"),
            spark.read.schema("request string").parquet(f"{sink}/dead"))
