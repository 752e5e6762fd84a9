"""Chart data (H1–H6): the tables behind the reference's plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.stats import qcol


def histogram(df: DataFrame, col: str, bins: int = 40, lo: float | None = None,
              hi: float | None = None, by: str | None = None,
              clip: tuple[float, float] | None = None) -> DataFrame:
    """H1/H2: equal-width bins over [lo, hi] (each group's own min..max when
    not given), last bin closed; every bin present (zero-filled). ``clip``
    first clips values into a display range (C8), as the reference does for
    visibility (0–15) and wind speed (0–60).

    Values outside [lo, hi] and rows of a NULL group are left out.
    Output: (by?, bin, bin_lo, bin_hi, count, density)."""
    keys = [by] if by else []
    v = qcol(col).cast("double")
    if clip is not None:
        v = F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(float(clip[0]))), F.lit(float(clip[1]))))
    d = df.select(*[qcol(k) for k in keys], v.alias("_v")).where(F.col("_v").isNotNull())
    for k in keys:
        d = d.where(qcol(k).isNotNull())
    if lo is not None and hi is not None:
        d = d.where(F.col("_v").between(lo, hi))
    if lo is None or hi is None:
        rng = d.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    else:
        rng = d.groupBy(*keys).agg(F.lit(float(lo)).alias("_lo"), F.lit(float(hi)).alias("_hi"),
                                   F.count(F.lit(1)).alias("_n"))
    if keys:
        j = d.join(rng, keys)
    else:
        r = rng.first()
        j = d.withColumn("_lo", F.lit(r["_lo"])).withColumn("_hi", F.lit(r["_hi"])).withColumn("_n", F.lit(r["_n"]))
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_lo")) / width * bins).cast("int"), F.lit(bins - 1)))
    counts = j.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = (rng.select(*keys, "_lo", "_hi", "_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
             if keys else
             df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")))
    if not keys:
        spine = spine.withColumn("_lo", F.lit(r["_lo"])).withColumn("_hi", F.lit(r["_hi"])).withColumn("_n", F.lit(r["_n"]))
    out = spine.join(counts, keys + ["bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    return out.select(
        *keys, "bin",
        (F.col("_lo") + F.col("bin") * w).alias("bin_lo"),
        (F.col("_lo") + (F.col("bin") + 1) * w).alias("bin_hi"),
        "count",
        F.try_divide(F.col("count").cast("double"), F.col("_n") * w).alias("density"))


def melt(df: DataFrame, id_cols: list[str], value_cols: list[str],
         var_name: str = "metric", value_name: str = "value") -> DataFrame:
    """H4: wide → long."""
    return df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in value_cols]) \
        .unpivot(id_cols, value_cols, var_name, value_name)


def map_points(df: DataFrame, n: int, key: str = "ID", seed: int = 42,
               cols: tuple = ("Start_Lat", "Start_Lng", "Severity", "City", "State")) -> DataFrame:
    """H3: complete-coordinate rows, reproducible hash sample of n."""
    from quarry.operators.eda import hash_sample
    d = df.na.drop(subset=["Start_Lat", "Start_Lng"]).select(key, *cols)
    return hash_sample(d, key, n, seed)


def key_findings(df: DataFrame) -> DataFrame:
    """H6: (finding, value) rows: dominant severity and its share, target
    rate, the two peak hours, busiest weekday, daylight share. Small
    aggregates (per severity / hour / weekday) feed one final row."""
    from quarry.operators.eda import DAY_NAMES
    pct = lambda c: F.format_string("%.2f", c)
    n = df.agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("rate"),
               F.avg((F.col("Sunrise_Sunset") == "Day").cast("double")).alias("day"))
    sev = df.groupBy("Severity").agg(F.count(F.lit(1)).alias("c")).agg(
        F.min_by("Severity", F.struct((-F.col("c")).alias("k"), F.col("Severity").alias("s"))).alias("sev"),
        F.max("c").alias("sev_n"))
    hours = df.groupBy("hour").agg(F.count(F.lit(1)).alias("c")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), F.col("hour").alias("h")))).alias("hs"))
    dow = df.groupBy("day_of_week").agg(F.count(F.lit(1)).alias("c")).agg(
        F.min_by("day_of_week", F.struct((-F.col("c")).alias("k"), F.col("day_of_week").alias("d"))).alias("dow"))
    names = F.array(*[F.lit(d) for d in DAY_NAMES])
    out = (n.withColumn("_k", F.lit(1))
           .join(sev.withColumn("_k", F.lit(1)), "_k")
           .join(hours.withColumn("_k", F.lit(1)), "_k")
           .join(dow.withColumn("_k", F.lit(1)), "_k"))
    items = [
        ("dominant_severity", F.col("sev").cast("string")),
        ("dominant_severity_share_pct", pct(F.col("sev_n") / F.col("n") * 100)),
        ("target_rate_pct", pct(F.col("rate") * 100)),
        ("peak_hours", F.concat_ws(" and ", F.col("hs")[0]["h"].cast("string"), F.col("hs")[1]["h"].cast("string"))),
        ("busiest_weekday", F.element_at(names, F.col("dow") + 1)),
        ("daylight_share_pct", pct(F.col("day") * 100)),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("finding"), v.alias("value")) for k, v in items])
    return out.select(F.explode(rows).alias("r")).select("r.finding", "r.value")


def report_tables(df: DataFrame, metrics: DataFrame | None = None) -> dict[str, DataFrame]:
    """H5: the report's tables as lazy DataFrames (each one aggregation);
    a table whose input columns are absent is left out."""
    from quarry.operators import eda
    cols = set(df.columns)
    specs = {
        "severity": (["Severity"], lambda: eda.value_counts(df, "Severity", normalize=True)),
        "years": (["year"], lambda: eda.counts_by(df, ["year"])),
        "top_states": (["State"], lambda: eda.top_k(df, "State", 10)),
        "top_cities": (["City", "State"], lambda: eda.top_cities(df, 10)),
        "top_weather": (["Weather_Condition"], lambda: eda.top_k(df, "Weather_Condition", 10)),
        "weather_rates": (["weather_category", "target"], lambda: eda.rate_by(df, "weather_category")),
    }
    out = {name: build() for name, (need, build) in specs.items() if set(need) <= cols}
    if metrics is not None:
        out["models"] = metrics.orderBy(F.col("test_auc").desc(), F.col("test_ap").desc())
    return out
