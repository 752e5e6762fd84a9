"""Evaluation queries (E1–E9, H4) over the scored documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import charts
from quarry.operators import evaluation as ev
from quarry.plans.catalog import register
from quarry.sources.scores import scores, scores_sql

SCORED = "WITH scored AS (" + scores_sql("duckdb") + "),\n"
COUNTS = SCORED + """sc AS (SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos,
  count(*) FILTER (WHERE label <> 1) AS neg FROM scored GROUP BY model, score),
cum AS (SELECT model, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
  sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N FROM sc
  WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
cm AS (SELECT model, count(*) FILTER (WHERE label <> 1 AND score < 0.5) AS c00,
  count(*) FILTER (WHERE label <> 1 AND score >= 0.5) AS c01,
  count(*) FILTER (WHERE label = 1 AND score < 0.5) AS c10,
  count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS c11 FROM scored GROUP BY model),
pr AS (SELECT model, c00 + c01 + c10 + c11 AS total,
  coalesce(c00 / nullif(c00 + c10, 0), 0) AS p0, coalesce(c00 / nullif(c00 + c01, 0), 0) AS r0,
  coalesce(c11 / nullif(c11 + c01, 0), 0) AS p1, coalesce(c11 / nullif(c11 + c10, 0), 0) AS r1,
  c00 + c01 AS s0, c10 + c11 AS s1, (c00 + c11) / (c00 + c01 + c10 + c11) AS acc FROM cm),
rep AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0,
  coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1 FROM pr),
auc AS (SELECT model, sum(neg * ((tp - pos) + pos / 2.0)) / (max(P) * max(N)) AS auc FROM cum GROUP BY model),
ap AS (SELECT model, sum(pos / P * (tp / (tp + fp))) AS ap FROM cum GROUP BY model),
br AS (SELECT model, avg((score - label) * (score - label)) AS brier FROM scored GROUP BY model)
"""
METRICS_SQL = COUNTS + """SELECT a.model, round(a.auc, 4) AS test_auc, round(p.ap, 4) AS test_ap,
  round(b.brier, 4) AS test_brier,
  round((r.f0 * r.s0 + r.f1 * r.s1) / r.total, 4) AS test_f1,
  round((r.p0 * r.s0 + r.p1 * r.s1) / r.total, 4) AS test_precision,
  round((r.r0 * r.s0 + r.r1 * r.s1) / r.total, 4) AS test_recall,
  round(r.acc, 4) AS test_accuracy
FROM auc a JOIN ap p USING (model) JOIN br b USING (model) JOIN rep r USING (model)"""


def _r(df, cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("roc_auc", SCORED + """r AS (SELECT model, label,
  rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS rk
  FROM scored)
SELECT model, round((sum(rk) FILTER (WHERE label = 1)
  - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label <> 1)), 6) AS auc
FROM r GROUP BY model""")
def roc_auc(spark, sf_dir):
    """E1 (checked against the rank-sum formula)."""
    return _r(ev.roc_auc(scores(spark, sf_dir)), ["auc"])


@register("roc_curve", COUNTS + """SELECT model, score AS threshold, round(fp / N, 6) AS fpr,
  round(tp / P, 6) AS tpr FROM cum
UNION ALL SELECT DISTINCT model, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM scored""")
def roc_curve(spark, sf_dir):
    """E2."""
    return _r(ev.roc_curve(scores(spark, sf_dir)), ["fpr", "tpr"])


@register("roc_curve_compact", COUNTS + """, nb AS (SELECT *, lag(fp) OVER o AS pf, lag(tp) OVER o AS pt,
  lead(fp) OVER o AS nf, lead(tp) OVER o AS nt FROM cum
  WINDOW o AS (PARTITION BY model ORDER BY score DESC))
SELECT model, score AS threshold, round(fp / N, 6) AS fpr, round(tp / P, 6) AS tpr FROM nb
WHERE pf IS NULL OR nf IS NULL OR nf - 2 * fp + pf <> 0 OR nt - 2 * tp + pt <> 0
UNION ALL SELECT DISTINCT model, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM scored""".replace(
    "\n, nb AS", ",\nnb AS"))
def roc_curve_compact(spark, sf_dir):
    """E2 with intermediate (equal-step) points dropped."""
    return _r(ev.roc_curve(scores(spark, sf_dir), drop_intermediate=True), ["fpr", "tpr"])


@register("pr_curve", COUNTS + """SELECT model, score AS threshold, round(tp / (tp + fp), 6) AS precision,
  round(tp / P, 6) AS recall FROM cum""")
def pr_curve(spark, sf_dir):
    """E3 curve."""
    return _r(ev.pr_curve(scores(spark, sf_dir)), ["precision", "recall"])


@register("average_precision", COUNTS + "SELECT model, round(ap, 6) AS ap FROM ap")
def average_precision(spark, sf_dir):
    """E3 average precision (step rule)."""
    return _r(ev.average_precision(scores(spark, sf_dir)), ["ap"])


@register("class_report", COUNTS + """SELECT model, '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall,
  round(f0, 6) AS f1, CAST(s0 AS DOUBLE) AS support FROM rep
UNION ALL SELECT model, '1', round(p1, 6), round(r1, 6), round(f1, 6), CAST(s1 AS DOUBLE) FROM rep
UNION ALL SELECT model, 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6),
  CAST(total AS DOUBLE) FROM rep
UNION ALL SELECT model, 'weighted avg', round((p0 * s0 + p1 * s1) / total, 6), round((r0 * s0 + r1 * s1) / total, 6),
  round((f0 * s0 + f1 * s1) / total, 6), CAST(total AS DOUBLE) FROM rep
UNION ALL SELECT model, 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), CAST(total AS DOUBLE) FROM rep""")
def class_report(spark, sf_dir):
    """E4 at threshold 0.5."""
    return _r(ev.class_report(scores(spark, sf_dir)), ["precision", "recall", "f1"])


@register("confusion", SCORED + """cells AS (SELECT DISTINCT s.model, a.actual, p.predicted FROM scored s,
  (SELECT unnest([0, 1]) AS actual) a, (SELECT unnest([0, 1]) AS predicted) p),
n AS (SELECT model, CAST(label = 1 AS INTEGER) AS actual, CAST(score >= 0.5 AS INTEGER) AS predicted,
  count(*) AS count FROM scored GROUP BY 1, 2, 3)
SELECT c.model, c.actual, c.predicted, CAST(coalesce(n.count, 0) AS BIGINT) AS count FROM cells c
LEFT JOIN n ON n.model = c.model AND n.actual = c.actual AND n.predicted = c.predicted""")
def confusion(spark, sf_dir):
    """E5."""
    return ev.confusion(scores(spark, sf_dir))


@register("brier", SCORED.rstrip(",\n") + "\nSELECT model, round(avg((score - label) * (score - label)), 6) AS brier "
          "FROM scored GROUP BY model")
def brier(spark, sf_dir):
    """E6."""
    return _r(ev.brier(scores(spark, sf_dir)), ["brier"])


_EDGES = "[" + ", ".join(f"CAST('{i * (1.0 / 10)!r}' AS DOUBLE)" for i in range(1, 10)) + "]"


@register("calibration", SCORED.rstrip(",\n") + f"""
SELECT model, CAST(len(list_filter({_EDGES}, lambda e: e < score)) AS INTEGER) AS bin,
  round(avg(CAST(label AS DOUBLE)), 6) AS frac_pos, round(avg(score), 6) AS mean_pred, count(*) AS count
FROM scored GROUP BY 1, 2""")
def calibration(spark, sf_dir):
    """E7 (10 bins)."""
    return _r(ev.calibration(scores(spark, sf_dir)), ["frac_pos", "mean_pred"])


_THR = "[" + ", ".join(f"CAST('{0.1 + 0.05 * i!r}' AS DOUBLE)" for i in range(16)) + "]"   # 0.10 … 0.85
SWEEP_SQL = SCORED + f"""t AS (SELECT unnest({_THR}) AS threshold),
c AS (SELECT s.model, t.threshold, count(*) FILTER (WHERE s.label = 1 AND s.score >= t.threshold) AS tp,
  count(*) FILTER (WHERE s.label <> 1 AND s.score >= t.threshold) AS fp,
  count(*) FILTER (WHERE s.label = 1) AS P FROM scored s, t GROUP BY 1, 2),
m AS (SELECT model, threshold, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp / nullif(P, 0), 0) AS recall FROM c),
sw AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)
"""


@register("threshold_sweep", SWEEP_SQL + """SELECT model, round(threshold, 2) AS threshold,
  round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sw""")
def threshold_sweep(spark, sf_dir):
    """16 thresholds 0.10 … 0.85."""
    out = ev.threshold_sweep(scores(spark, sf_dir))
    return _r(out.withColumn("threshold", F.round("threshold", 2)), ["precision", "recall", "f1"])


@register("best_threshold", SWEEP_SQL + """SELECT model, round(threshold, 2) AS threshold, round(f1, 6) AS f1
FROM sw QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) = 1""")
def best_threshold(spark, sf_dir):
    """First threshold with the best F1."""
    out = ev.best_threshold(ev.threshold_sweep(scores(spark, sf_dir)))
    return _r(out.withColumn("threshold", F.round("threshold", 2)), ["f1"])


@register("metrics_table", METRICS_SQL)
def metrics_table(spark, sf_dir):
    """One metrics row per model (4 dp)."""
    return ev.metrics_table(scores(spark, sf_dir))


_METRIC_COLS = ["test_auc", "test_ap", "test_brier", "test_f1", "test_precision", "test_recall", "test_accuracy"]


@register("metrics_long", "WITH mt AS (" + METRICS_SQL.replace("WITH scored AS", "SELECT * FROM (WITH scored AS", 1)
          + ") x)\n" + "\nUNION ALL ".join(f"SELECT model, '{c}' AS metric, {c} AS value FROM mt" for c in _METRIC_COLS))
def metrics_long(spark, sf_dir):
    """H4: metrics table melted to (model, metric, value)."""
    return charts.melt(ev.metrics_table(scores(spark, sf_dir)), ["model"], _METRIC_COLS)
