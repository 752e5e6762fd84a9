"""Exact model-evaluation operators (E1–E9) over (model?, label, score).

Everything starts by aggregating rows to distinct scores (pos, neg counts per
score), which is a map-side-combined shuffle. Curves need cumulative counts
in score order; a global ordered window would run in one partition, so the
cumulative sums use ``running_totals`` (range totals + per-range windows) over
``ranged`` distinct scores, whose ranges hold about equally many of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.stats import ranged, running_totals

THRESHOLDS = [0.1 + 0.05 * i for i in range(16)]   # 0.10 … 0.85


def _keys(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def score_counts(df: DataFrame, by=("model",), label: str = "label", score: str = "score") -> DataFrame:
    """(by…, score, pos, neg) — one row per distinct score."""
    k = _keys(by)
    return df.groupBy(*k, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).cast("long").alias("pos"),
        F.count_if(F.col(label) != 1).cast("long").alias("neg"))


def cumulative(df: DataFrame, by=("model",), label: str = "label", score: str = "score",
               ranges: int | None = None) -> DataFrame:
    """(by…, score, pos, neg, tp, fp, P, N): counts at threshold ≥ score, scores descending."""
    return _cumulative(df, _keys(by), label, score, ranges).drop("_range")


def _cumulative(df: DataFrame, k: list[str], label: str = "label", score: str = "score",
                ranges: int | None = None) -> DataFrame:
    """``cumulative`` with the ``_range`` of each score."""
    sc = score_counts(df, k, label, score)
    grouped = bool(k)
    if not grouped:                      # one group: a constant key keeps it a keyed join
        sc, k = sc.withColumn("_all", F.lit(0)), ["_all"]
    sc = ranged(sc, k, "score", ranges)
    cum = running_totals(sc, k, "score", ["pos", "neg"], F.col("_range"), descending=True)
    cum = cum.withColumnRenamed("cum_pos", "tp").withColumnRenamed("cum_neg", "fp")
    tot = sc.groupBy(*k).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    out = cum.join(tot, k)
    return out if grouped else out.drop("_all")


def roc_auc(df: DataFrame, by=("model",), **kw) -> DataFrame:
    """Tie-aware ROC AUC = Σ neg·(tp_before + pos/2) / (P·N)."""
    k = _keys(by)
    c = cumulative(df, k, **kw)
    contrib = F.col("neg") * ((F.col("tp") - F.col("pos")) + F.col("pos") / 2.0)
    return c.groupBy(*k).agg(F.try_divide(F.sum(contrib), F.first("P").cast("double") * F.first("N").cast("double")).alias("auc"))


def roc_curve(df: DataFrame, by=("model",), drop_intermediate: bool = False, **kw) -> DataFrame:
    """(by…, threshold, fpr, tpr), one point per distinct score plus the
    (0, 0) origin at threshold +inf.

    ``drop_intermediate`` removes a point whose step from its predecessor in
    both fp and tp equals the step to its successor (second differences both
    zero; the first and last score points are kept). Neighbours come from
    lag/lead inside a score range and, at range edges, from a per-range
    table of end points (models × ranges rows), so no window spans a whole
    model."""
    k = _keys(by)
    c = _cumulative(df, k, **kw)
    if drop_intermediate:
        c = _drop_collinear(c, k)
    pts = c.select(*k, F.col("score").alias("threshold"),
                   F.try_divide(F.col("fp").cast("double"), F.col("N")).alias("fpr"),
                   F.try_divide(F.col("tp").cast("double"), F.col("P")).alias("tpr"))
    origin = c.groupBy(*k).agg(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                               F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def _drop_collinear(c: DataFrame, k: list[str]) -> DataFrame:
    d = c.withColumnRenamed("_range", "_b")
    pt = F.struct(F.col("score").alias("s"), F.col("fp").alias("fp"), F.col("tp").alias("tp"))
    ends = d.groupBy(*k, "_b").agg(F.max_by(pt, F.col("score")).alias("_first"),
                                   F.min_by(pt, F.col("score")).alias("_last"))
    wb = Window.partitionBy(*k).orderBy(F.col("_b").desc())
    ends = ends.select(*k, "_b", F.lag("_last").over(wb).alias("_prev_end"),
                       F.lead("_first").over(wb).alias("_next_start"))
    w = Window.partitionBy(*k, "_b").orderBy(F.col("score").desc())
    j = d.join(ends, k + ["_b"])
    prev_fp = F.coalesce(F.lag("fp").over(w), F.col("_prev_end.fp"))
    prev_tp = F.coalesce(F.lag("tp").over(w), F.col("_prev_end.tp"))
    next_fp = F.coalesce(F.lead("fp").over(w), F.col("_next_start.fp"))
    next_tp = F.coalesce(F.lead("tp").over(w), F.col("_next_start.tp"))
    j = j.withColumn("_pf", prev_fp).withColumn("_pt", prev_tp) \
         .withColumn("_nf", next_fp).withColumn("_nt", next_tp)
    inner = F.col("_pf").isNotNull() & F.col("_nf").isNotNull()
    flat = ((F.col("_nf") - 2 * F.col("fp") + F.col("_pf")) == 0) & \
           ((F.col("_nt") - 2 * F.col("tp") + F.col("_pt")) == 0)
    return j.where(~(inner & flat)).drop("_b", "_prev_end", "_next_start", "_pf", "_pt", "_nf", "_nt")


def pr_curve(df: DataFrame, by=("model",), **kw) -> DataFrame:
    """(by…, threshold, precision, recall) per distinct score."""
    k = _keys(by)
    c = cumulative(df, k, **kw)
    return c.select(*k, F.col("score").alias("threshold"),
                    (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    F.try_divide(F.col("tp").cast("double"), F.col("P")).alias("recall"))


def average_precision(df: DataFrame, by=("model",), **kw) -> DataFrame:
    """AP = Σ (R_k − R_{k−1}) · P_k over thresholds descending (step rule);
    R_k − R_{k−1} = pos_k / P, so no ordered window is needed."""
    k = _keys(by)
    c = cumulative(df, k, **kw)
    term = F.try_divide(F.col("pos").cast("double"), F.col("P")) * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return c.groupBy(*k).agg(F.sum(term).alias("ap"))


def confusion(df: DataFrame, by=("model",), threshold: float = 0.5, label: str = "label",
              score: str = "score") -> DataFrame:
    """E5: 2×2 counts, zero-filled (conditional sums: every cell always exists)."""
    k = _keys(by)
    pred = F.col(score) >= threshold
    act = F.col(label) == 1
    wide = df.groupBy(*k).agg(
        F.count_if(~act & ~pred).cast("long").alias("c00"), F.count_if(~act & pred).cast("long").alias("c01"),
        F.count_if(act & ~pred).cast("long").alias("c10"), F.count_if(act & pred).cast("long").alias("c11"))
    cells = F.explode(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"c{a}{p}").alias("count"))
        for a in (0, 1) for p in (0, 1)]))
    return wide.select(*k, cells.alias("c")).select(*k, "c.actual", "c.predicted", "c.count")


def class_report(df: DataFrame, by=("model",), threshold: float = 0.5, **kw) -> DataFrame:
    """Per class, macro avg, weighted avg: precision, recall, f1, support;
    plus an accuracy row. Undefined ratios are 0."""
    k = _keys(by)
    c = confusion(df, k, threshold, **kw)
    w = c.groupBy(*k).agg(*[F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("count")))
                            .alias(f"c{a}{p}") for a in (0, 1) for p in (0, 1)])

    def z(x):
        return F.coalesce(x, F.lit(0.0))

    rows = []
    for cls in (0, 1):
        tp = F.col(f"c{cls}{cls}")
        fp = F.col(f"c{1 - cls}{cls}")
        fn = F.col(f"c{cls}{1 - cls}")
        prec = z(F.try_divide(tp.cast("double"), tp + fp))
        rec = z(F.try_divide(tp.cast("double"), tp + fn))
        f1 = z(F.try_divide(2 * prec * rec, prec + rec))
        rows.append((str(cls), prec, rec, f1, (tp + fn).cast("double")))
    total = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    macro = tuple((rows[0][i] + rows[1][i]) / 2 for i in (1, 2, 3))
    weighted = tuple(z(F.try_divide(rows[0][i] * rows[0][4] + rows[1][i] * rows[1][4], total.cast("double")))
                     for i in (1, 2, 3))
    acc = z(F.try_divide((F.col("c00") + F.col("c11")).cast("double"), total))
    structs = [F.struct(F.lit(n).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        s.alias("support")) for n, p, r, f, s in rows]
    structs.append(F.struct(F.lit("macro avg").alias("class"), macro[0].alias("precision"),
                            macro[1].alias("recall"), macro[2].alias("f1"), total.cast("double").alias("support")))
    structs.append(F.struct(F.lit("weighted avg").alias("class"), weighted[0].alias("precision"),
                            weighted[1].alias("recall"), weighted[2].alias("f1"),
                            total.cast("double").alias("support")))
    structs.append(F.struct(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"),
                            acc.alias("f1"), total.cast("double").alias("support")))
    return w.select(*k, F.explode(F.array(*structs)).alias("r")).select(*k, "r.*")


def brier(df: DataFrame, by=("model",), label: str = "label", score: str = "score") -> DataFrame:
    """E6."""
    k = _keys(by)
    return df.groupBy(*k).agg(F.avg((F.col(score) - F.col(label)) ** 2).alias("brier"))


def calibration(df: DataFrame, by=("model",), n_bins: int = 10, label: str = "label",
                score: str = "score") -> DataFrame:
    """Uniform bins, right-closed (bin = inner edges strictly below the
    score), empty bins absent: (by…, bin, frac_pos, mean_pred, count)."""
    k = _keys(by)
    edges = F.array(*[F.lit(i * (1.0 / n_bins)) for i in range(1, n_bins)])
    b = F.size(F.filter(edges, lambda e: e < F.col(score)))
    return df.groupBy(*k, b.alias("bin")).agg(
        F.avg(F.col(label).cast("double")).alias("frac_pos"), F.avg(score).alias("mean_pred"),
        F.count(F.lit(1)).alias("count"))


def threshold_sweep(df: DataFrame, by=("model",), thresholds=THRESHOLDS, label: str = "label",
                    score: str = "score") -> DataFrame:
    """Precision, recall, F1 of the positive class at each threshold.
    Conditional counts in one aggregation over the distinct-score table
    (no cross join of rows × thresholds)."""
    k = _keys(by)
    sc = score_counts(df, k, label, score)
    aggs = []
    for i, t in enumerate(thresholds):
        aggs.append(F.sum(F.when(F.col("score") >= t, F.col("pos")).otherwise(0)).alias(f"tp{i}"))
        aggs.append(F.sum(F.when(F.col("score") >= t, F.col("neg")).otherwise(0)).alias(f"fp{i}"))
    aggs.append(F.sum("pos").alias("P"))
    wide = sc.groupBy(*k).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                                        F.col(f"fp{i}").alias("fp")) for i, t in enumerate(thresholds)]))
    long = wide.select(*k, "P", rows.alias("r")).select(*k, "P", "r.*")
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("P")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return long.select(*k, "threshold", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def best_threshold(sweep: DataFrame, by=("model",)) -> DataFrame:
    """First threshold with the maximal F1 per group."""
    k = _keys(by)
    return sweep.groupBy(*k).agg(F.min_by(F.struct("threshold", "f1"),
                                          F.struct((-F.col("f1")).alias("a"), F.col("threshold").alias("b")))
                                 .alias("best")).select(*k, "best.threshold", "best.f1")


def metrics_table(df: DataFrame, by=("model",), threshold: float = 0.5, digits: int = 4,
                  label: str = "label", score: str = "score") -> DataFrame:
    """test_auc, test_ap, test_brier, weighted f1/precision/recall, accuracy.

    Two aggregations: AUC and AP from one cumulative distinct-score table,
    Brier and the confusion counts from one pass over the rows."""
    k = _keys(by)
    c = cumulative(df, k, label=label, score=score)
    rank = c.groupBy(*k).agg(
        F.try_divide(F.sum(F.col("neg") * ((F.col("tp") - F.col("pos")) + F.col("pos") / 2.0)),
                     F.first("P").cast("double") * F.first("N").cast("double")).alias("auc"),
        F.sum(F.try_divide(F.col("pos").cast("double"), F.col("P")) *
              (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("ap"))
    pred, act = F.col(score) >= threshold, F.col(label) == 1
    cm = df.groupBy(*k).agg(
        F.avg((F.col(score) - F.col(label)) ** 2).alias("brier"),
        F.count_if(~act & ~pred).alias("c00"), F.count_if(~act & pred).alias("c01"),
        F.count_if(act & ~pred).alias("c10"), F.count_if(act & pred).alias("c11"))

    def z(x):
        return F.coalesce(x, F.lit(0.0))

    c00, c01, c10, c11 = (F.col(n).cast("double") for n in ("c00", "c01", "c10", "c11"))
    total = c00 + c01 + c10 + c11
    p0, r0 = z(F.try_divide(c00, c00 + c10)), z(F.try_divide(c00, c00 + c01))
    p1, r1 = z(F.try_divide(c11, c11 + c01)), z(F.try_divide(c11, c11 + c10))
    f0, f1 = z(F.try_divide(2 * p0 * r0, p0 + r0)), z(F.try_divide(2 * p1 * r1, p1 + r1))
    s0, s1 = c00 + c01, c10 + c11

    def weighted(a, b):
        return z(F.try_divide(a * s0 + b * s1, total))

    out = rank.join(cm, k) if k else rank.withColumn("_k", F.lit(1)).join(cm.withColumn("_k", F.lit(1)), "_k")
    return out.select(*k, *[F.round(e, digits).alias(n) for e, n in [
        (F.col("auc"), "test_auc"), (F.col("ap"), "test_ap"), (F.col("brier"), "test_brier"),
        (weighted(f0, f1), "test_f1"), (weighted(p0, p1), "test_precision"),
        (weighted(r0, r1), "test_recall"), (z(F.try_divide(c00 + c11, total)), "test_accuracy")]])
