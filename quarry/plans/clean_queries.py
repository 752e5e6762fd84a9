"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.stats import column_modes_df, exact_quantiles, qcol, to_long
from quarry.functions.text import standardise
from quarry.operators import clean as C
from quarry.plans.catalog import register
from quarry.plans.oracle_base import CAP, over_cleaned, over_raw, q
from quarry.plans.stages import cleaned, filtered, raw



@register("dedup", over_raw(
    "SELECT ID, min(_order) AS _order, count(*) AS copies FROM raw GROUP BY ID"))
def dedup(spark, sf_dir):
    """Surviving source row per ID (first in source order) and copy count."""
    return raw(spark, sf_dir).groupBy("ID").agg(F.min("_order").alias("_order"), F.count(F.lit(1)).alias("copies"))


_MEDIAN_COLS = ["Temperature(F)", "Visibility(mi)", "Precipitation(in)"]
_MODE_COLS = ["Street", "Timezone", "Weather_Condition"]


@register("impute", over_cleaned("\nUNION ALL ".join(
    [f"SELECT '{c}' AS column, CAST(round(quantile_cont({q(c)}, 0.5), 6) AS VARCHAR) AS fill_value FROM f"
     for c in _MEDIAN_COLS]
    + [f"SELECT '{c}', (SELECT {q(c)} FROM f WHERE {q(c)} IS NOT NULL GROUP BY {q(c)} "
       f"ORDER BY count(*) DESC, {q(c)} LIMIT 1)" for c in _MODE_COLS])))
def impute(spark, sf_dir):
    """The median (numeric) and mode (text) each NULL is replaced by."""
    d, _ = filtered(spark, sf_dir)
    med = exact_quantiles(d, _MEDIAN_COLS, [0.5]).select(
        "column", F.round("value", 6).cast("string").alias("fill_value"))
    modes = column_modes_df(d, _MODE_COLS).select("column", F.col("mode").alias("fill_value"))
    return med.unionByName(modes)


@register("iqr_cap", over_cleaned("\nUNION ALL ".join(
    f"SELECT '{c}' AS column, round(quantile_cont({q(c)}, 0.25), 6) AS q1, "
    f"round(quantile_cont({q(c)}, 0.75), 6) AS q3, "
    f"round(quantile_cont({q(c)}, 0.25) - 3.0 * (quantile_cont({q(c)}, 0.75) - quantile_cont({q(c)}, 0.25)), 6) AS lower, "
    f"round(quantile_cont({q(c)}, 0.75) + 3.0 * (quantile_cont({q(c)}, 0.75) - quantile_cont({q(c)}, 0.25)), 6) AS upper, "
    f"count(*) FILTER (WHERE {q(c)} < quantile_cont_lo_{i} OR {q(c)} > quantile_cont_hi_{i}) AS n_capped FROM f, "
    f"(SELECT quantile_cont({q(c)}, 0.25) - 3.0 * (quantile_cont({q(c)}, 0.75) - quantile_cont({q(c)}, 0.25)) AS quantile_cont_lo_{i}, "
    f"quantile_cont({q(c)}, 0.75) + 3.0 * (quantile_cont({q(c)}, 0.75) - quantile_cont({q(c)}, 0.25)) AS quantile_cont_hi_{i} FROM f) b{i}"
    for i, c in enumerate(CAP))))
def iqr_cap(spark, sf_dir):
    """Quartiles, capping bounds (factor 3) and the number of values capped."""
    d, _ = filtered(spark, sf_dir)
    qs = exact_quantiles(d, CAP, [0.25, 0.75])
    b = qs.groupBy("column").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"))
    b = b.withColumn("lower", F.col("q1") - C.IQR_FACTOR * (F.col("q3") - F.col("q1"))) \
         .withColumn("upper", F.col("q3") + C.IQR_FACTOR * (F.col("q3") - F.col("q1")))
    long = to_long(d, CAP)
    capped = long.join(F.broadcast(b.select("column", "lower", "upper")), "column") \
        .groupBy("column").agg(F.count_if((F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper")))
                               .alias("n_capped"))
    return b.join(capped, "column").select(
        "column", *[F.round(c, 6).alias(c) for c in ("q1", "q3", "lower", "upper")], "n_capped")


def _title_sql(expr: str) -> str:
    return ("array_to_string(list_transform(regexp_extract_all(trim(" + expr + "), '(\\p{L}+|[^\\p{L}]+)'), "
            "lambda t: upper(t[1]) || lower(t[2:])), '')")


_TITLE_COLS = ["City", "Street", "Weather_Condition", "County"]


@register("title_case", over_raw("\nUNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS column, {q(c)} AS raw_value, {_title_sql(q(c))} AS clean_value "
    f"FROM raw WHERE {q(c)} IS NOT NULL" for c in _TITLE_COLS)))
def title_case(spark, sf_dir):
    """Every distinct raw text and its standardised form."""
    texts = to_long(raw(spark, sf_dir), _TITLE_COLS, cast="string", value="raw_value").where(
        F.col("raw_value").isNotNull()).distinct()
    return texts.select("column", "raw_value", standardise(F.col("raw_value")).alias("clean_value"))


_CLEAN_COLS = ["ID", "Severity", "Start_Lat", "Start_Lng", *CAP, "City", "Street", "Weather_Condition",
               "Timezone", "Station", "State"]


@register("clean_table", over_cleaned(
    "SELECT " + ", ".join(f"round({q(c)}, 6) AS {q(c)}" if c in CAP else q(c) for c in _CLEAN_COLS)
    + " FROM cleaned"))
def clean_table(spark, sf_dir):
    """The cleaned table (dedup → drop → filters → cap → impute → title case)."""
    d = cleaned(spark, sf_dir)
    return d.select(*[F.round(qcol(c), 6).alias(c) if c in CAP else qcol(c) for c in _CLEAN_COLS])


@register("percentile_clip", over_cleaned(
    "SELECT round(min(v), 6) AS min_value, round(max(v), 6) AS max_value, count(*) AS count FROM ("
    "SELECT least(greatest(\"Distance(mi)\", (SELECT quantile_cont(\"Distance(mi)\", 0.01) FROM cleaned)), "
    "(SELECT quantile_cont(\"Distance(mi)\", 0.99) FROM cleaned)) AS v FROM cleaned)"))
def percentile_clip(spark, sf_dir):
    """Distance clipped to its 1 %–99 % range for display."""
    d = C.percentile_clip(cleaned(spark, sf_dir).select(qcol("Distance(mi)")), "Distance(mi)")
    return d.agg(F.round(F.min(qcol("Distance(mi)")), 6).alias("min_value"),
                 F.round(F.max(qcol("Distance(mi)")), 6).alias("max_value"),
                 F.count(F.lit(1)).alias("count"))
