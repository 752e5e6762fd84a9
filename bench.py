"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is executed in full with the ``noop`` sink (no collect). The
first entry, ``build_processed``, is the one-off raw → cleaned → processed
stage build that every EDA query then scans.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "severity_by_hour", "stats", "severity_by_state", "top_cities", "mean_marginals", "marginals",
    "weather_severity_grid", "day_hour_pivot", "flag_stats", "report_facts", "describe", "box_stats",
    "corr_long", "histogram", "missing_fraction", "removed_rows", "dedup", "request_violations",
    "roc_auc", "roc_curve", "average_precision", "metrics_table", "threshold_sweep", "calibration",
    "split_sizes", "feature_table", "severity_counts", "key_findings", "visibility_histogram",
    "top_weather", "top_city_states",
]


def model_times(spark, sf_dir: str, rounds: int = 50) -> dict:
    """Seconds and rows/s of one linear fit, ``rounds`` rounds of each boosted profile, and scoring; not in the total."""
    import dataclasses

    from quarry.operators import boosting, ml
    from quarry.plans.model_queries import data

    rows, feats = data(spark, sf_dir)
    train = rows.where("split = 'train'")
    n, out = train.count(), {}

    def note(name: str, seconds: float, count: int) -> None:
        out[name] = {"sec": round(seconds, 2), "rows_per_sec": round(count / seconds)}

    t = time.time()
    ml.fit_model("logistic_regression", train, feats)
    note("train_logistic_regression", time.time() - t, n)
    for name in ("boosted_a", "boosted_b"):
        p = ml.PROFILES["full"][name]
        d = ml.with_class_weights(train, mode="pos", pos_weight=p["pos_weight"]) if "pos_weight" in p else ml.with_class_weights(train)
        t = time.time()
        model = boosting.fit(d, feats, dataclasses.replace(ml.boosting_params(p), rounds=rounds))
        note(f"train_{name}_{rounds}_rounds", time.time() - t, n * rounds)
    t = time.time()
    ml.score(model, rows).write.format("noop").mode("overwrite").save()
    note(f"score_boosted_{rounds}_trees", time.time() - t, rows.count())
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from quarry.plans import catalog
    from quarry.plans.stages import processed
    from quarry.session import get_session

    spark = get_session(app="quarry-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load_all()
    times = {}
    t = time.time()
    processed(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times["build_processed"] = round(time.time() - t, 3)
    for name in HEADLINE:
        t = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    models = model_times(spark, sf_dir)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus),
        "models": models,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
