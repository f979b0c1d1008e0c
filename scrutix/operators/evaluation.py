"""Scorer quality: ROC, thresholds, calibration and logistic fits.

Inputs are ``(score DOUBLE, label INT)``; a null score is skipped.  Curves are
built on distinct scores with prefix sums over ``BUCKETS`` value ranges, so no
step sorts or sums everything in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrutix.sources.tables import materialize

BUCKETS = 64


def validate(df: DataFrame) -> None:
    """Raise for labels other than 0 and 1 or scores that aren't finite."""
    bad = df.filter(~F.coalesce(F.col("label").isin(0, 1), F.lit(False)) | F.col("score").isin(float("nan"), float("inf"), float("-inf"))).limit(1)
    if not bad.isEmpty():
        raise ValueError("labels must be 0 or 1 and scores finite")


def roc_points(df: DataFrame) -> DataFrame:
    """``(score, pos, neg, tp, fp, p, n)`` for each distinct score; tp and fp count scores at or above.

    ``df`` is read once: counts by score are written as a table, from which
    ranges, sums and points come.
    """
    g = df.filter("score IS NOT NULL").groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    g = materialize(g, "roc-scores")
    bounds = g.agg(F.percentile_approx("score", [i / BUCKETS for i in range(1, BUCKETS)], 10000)).first()[0] or []
    cuts = sorted(set(bounds))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b > F.col("score"))) if cuts else F.lit(0)
    g = g.withColumn("_b", bucket)
    # at most BUCKETS rows stand for the ranges
    per = g.groupBy("_b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select("_b", F.coalesce(F.sum("bp").over(w), F.lit(0)).alias("p0"), F.coalesce(F.sum("bn").over(w), F.lit(0)).alias("n0"), F.sum("bp").over(every).alias("p"), F.sum("bn").over(every).alias("n"))
    inside = Window.partitionBy("_b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = g.withColumns({"tp": F.sum("pos").over(inside), "fp": F.sum("neg").over(inside)}).join(F.broadcast(per), "_b")
    return out.select("score", "pos", "neg", (F.col("tp") + F.col("p0")).alias("tp"), (F.col("fp") + F.col("n0")).alias("fp"), "p", "n")


def auc(points: DataFrame) -> DataFrame:
    """One row: ROC-AUC with ties counted half; null with a single class."""
    below = F.col("n") - F.col("fp")
    return points.agg(F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("s"), F.max("p").alias("p"), F.max("n").alias("n")).select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("s") / (F.col("p") * F.col("n"))).alias("auc"))


def tpr_at_fpr(points: DataFrame, target: float) -> DataFrame:
    """One row: the largest TPR within a FPR budget, interpolated to the next point."""
    if not 0 <= target <= 1:
        raise ValueError("the target must be in [0, 1]")
    t = points.filter("p > 0 AND n > 0").select((F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"))
    inside, beyond = F.col("fpr") <= target, F.col("fpr") > target
    t = t.agg(F.count("*").alias("k"), F.max(F.when(inside, F.struct("fpr", "tpr"))).alias("a"), F.min(F.when(beyond, F.struct("fpr", "tpr"))).alias("b"))
    x0, y0 = F.coalesce("a.fpr", F.lit(0.0)), F.coalesce("a.tpr", F.lit(0.0))
    value = F.when(F.col("b").isNotNull(), y0 + (target - x0) / (F.col("b.fpr") - x0) * (F.col("b.tpr") - y0)).otherwise(y0)
    return t.select(F.when(F.col("k") > 0, value).alias("tpr"))


def _metrics(tp, fp, fn, tn) -> dict:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": precision, "recall": recall, "f1": F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0), "accuracy": ratio(tp + tn, tp + fp + fn + tn), "fpr": ratio(fp, fp + tn)}


def confusion(df: DataFrame, threshold: float) -> DataFrame:
    """One row: counts and rates when scores at or above the threshold are positive."""
    hit, one = F.col("score") >= threshold, F.col("label") == 1
    c = df.filter("score IS NOT NULL").agg(F.count_if(hit & one).alias("tp"), F.count_if(hit & ~one).alias("fp"), F.count_if(~hit & one).alias("fn"), F.count_if(~hit & ~one).alias("tn"))
    return c.withColumns(_metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def best_f1(points: DataFrame) -> DataFrame:
    """One row: the threshold with the highest F1, the higher one on ties."""
    tp, fp = F.col("tp"), F.col("fp")
    m = _metrics(tp, fp, F.col("p") - tp, F.col("n") - fp)
    return points.select("score", tp, fp, m["f1"].alias("f1")).agg(F.max(F.struct("f1", "score", "tp", "fp")).alias("x")).select(F.col("x.score").alias("threshold"), "x.f1", "x.tp", "x.fp")


def calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    """One row: expected calibration error and Brier score; null if a score is outside [0, 1]."""
    s = df.filter("score IS NOT NULL")
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    per = s.groupBy(b.alias("b")).agg(F.count("*").alias("k"), F.avg("score").alias("c"), F.avg("label").alias("a"), F.sum((F.col("score") - F.col("label")) ** 2).alias("e"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    one = per.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.abs(F.col("c") - F.col("a"))).alias("g"), F.sum("e").alias("e"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ok = (F.col("n") > 0) & (F.col("lo") >= 0) & (F.col("hi") <= 1)
    return one.select(F.when(ok, F.col("g") / F.col("n")).alias("ece"), F.when(ok, F.col("e") / F.col("n")).alias("brier"))


def report(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row with every measure; rows without a score are counted as skipped."""
    points = roc_points(df)
    scored = F.col("score").isNotNull()
    counts = df.agg(F.count_if(scored).alias("scored"), F.count_if(scored & (F.col("label") == 1)).alias("positive"), F.count_if(scored & (F.col("label") == 0)).alias("negative"), F.count_if(~scored).alias("skipped"))
    tprs = [tpr_at_fpr(points, t / 100).withColumnRenamed("tpr", f"tpr_at_{t}pct") for t in (1, 5, 10)]
    parts = [counts, auc(points), *tprs, confusion(df, threshold), best_f1(points).select(F.col("threshold").alias("best_threshold"), F.col("f1").alias("best_f1")), calibration_error(df)]
    out = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_k", F.lit(1)), "_k", "left")  # one row each
    return out.drop("_k")


# --- fits --------------------------------------------------------------------


def fit_logistic(df: DataFrame, features: list[str], label: str = "label", l2: float = 1.0, rate: float = 0.1, steps: int = 2000, limit: int = 100_000) -> dict:
    """Full-batch gradient descent on standardised features.

    Spark reduces the table to distinct feature vectors with counts; with at
    most ``limit`` of them the descent runs on the driver.  A larger table
    stays distributed: Newton's method on the same penalised loss, one
    aggregation a step, reaches the optimum that the descent approaches.
    """
    import numpy as np

    groups = df.groupBy(*features, label).count().limit(limit + 1).collect()
    if len(groups) > limit:
        return _fit_newton(df, features, label, l2)
    if not groups:
        raise ValueError("cannot fit on an empty table")
    x = np.array([[float(g[f]) for f in features] for g in groups]).reshape(len(groups), len(features))
    y, k = np.array([float(g[label]) for g in groups]), np.array([float(g["count"]) for g in groups])
    n = k.sum()
    mean = (k @ x) / n
    std = np.sqrt((k @ (x - mean) ** 2) / n)
    std[std <= 1e-12] = 1.0
    z = (x - mean) / std
    w, b = np.zeros(len(features)), 0.0
    for _ in range(steps):
        e = k * (1 / (1 + np.exp(-np.clip(b + z @ w, -60, 60))) - y)
        w, b = w - rate * (e @ z + l2 * w) / n, b - rate * e.sum() / n
    return {"bias": float(b - (w * mean / std).sum()), "weights": dict(zip(features, map(float, w / std))), "trained_on": int(n)}


def _fit_newton(df: DataFrame, features: list[str], label: str, l2: float, steps: int = 12) -> dict:
    import numpy as np

    d = len(features)
    stats = df.agg(F.count("*").alias("n"), *(x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}")))).first()
    n = stats["n"]
    mean = np.array([stats[f"m_{f}"] for f in features], float)
    std = np.array([stats[f"s_{f}"] if stats[f"s_{f}"] > 1e-12 else 1.0 for f in features], float)
    t = df.select(F.array(F.lit(1.0), *((F.col(f) - m) / s for f, m, s in zip(features, mean.tolist(), std.tolist()))).alias("z"), F.col(label).cast("double").alias("y"))
    w = np.zeros(d + 1)
    z = lambda i: F.get("z", F.lit(i))
    for _ in range(steps):
        at = F.aggregate(F.zip_with("z", F.array(*map(F.lit, w.tolist())), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        s = t.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.least(at, F.lit(60.0)), F.lit(-60.0))))).withColumns({"e": F.col("p") - F.col("y"), "v": F.col("p") * (1 - F.col("p"))})
        r = s.agg(*(F.sum(F.col("e") * z(i)) for i in range(d + 1)), *(F.sum(F.col("v") * z(i) * z(j)) for i in range(d + 1) for j in range(i, d + 1))).first()
        penalty = l2 * np.r_[0.0, w[1:]]
        hessian = np.zeros((d + 1, d + 1))
        hessian[np.triu_indices(d + 1)] = r[d + 1 :]
        hessian += np.triu(hessian, 1).T + np.diag([1e-9] + [l2] * d)
        step = np.linalg.solve(hessian, np.array(r[: d + 1]) + penalty)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return {"bias": float(w[0] - (w[1:] * mean / std).sum()), "weights": dict(zip(features, map(float, w[1:] / std))), "trained_on": int(n)}


def predicted(model: dict) -> Column:
    """A fitted model's probability over its feature columns."""
    z = F.lit(model["bias"])
    for f, w in model["weights"].items():
        z = z + F.lit(w) * F.col(f)
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(60.0)), F.lit(-60.0))))


def fit_platt(df: DataFrame, l2: float = 1.0) -> dict:
    """Platt scaling of ``(score, label)``: the model, and calibration before and after it."""
    t = df.filter("score IS NOT NULL").select(F.col("score").cast("double").alias("score"), "label")
    model = fit_logistic(t, ["score"], l2=l2)
    before = calibration_error(t).first()
    after = calibration_error(t.select(predicted(model).alias("score"), "label")).first()
    return {"model": model, "n": model["trained_on"], "ece_before": before.ece, "ece_after": after.ece, "brier_before": before.brier, "brier_after": after.brier}


def signal_features(scored: DataFrame) -> tuple[DataFrame, list[str]]:
    """Activations of the signals that fire anywhere in ``scored`` (signals, label), and their sorted names."""
    from scrutix.functions.lexicons import SIGNALS

    from .scoring import activation

    hits = lambda k: F.filter("signals", lambda s: s["name"] == k)
    value = lambda k: F.when(F.size(hits(k)) > 0, activation(F.get(hits(k), F.lit(0))["count"])).otherwise(0.0)
    t = materialize(scored.select("label", *(value(k).cast("double").alias(k) for k in sorted(SIGNALS))), "signal-features")
    seen = t.agg(*(F.max(k).alias(k) for k in sorted(SIGNALS))).first()
    names = [k for k in sorted(SIGNALS) if seen[k]]
    return t.select("label", *names), names


def learn_weights(scored: DataFrame, l2: float = 2.0) -> dict:
    """Weights of signals from scored examples (signals, label), as a weights file holds them.

    ``train_auc`` is measured on the examples themselves, so it flatters.
    """
    t, names = signal_features(scored)
    if not names:
        raise ValueError("no signal fired on any example; there is nothing to learn from")
    model = fit_logistic(t, names, l2=l2)
    area = auc(roc_points(t.select(predicted(model).alias("score"), "label"))).first().auc
    return {"bias": round(model["bias"], 6), "weights": {k: round(v, 6) for k, v in model["weights"].items()}, "trained_on": model["trained_on"], "train_auc": None if area is None else round(area, 4), "l2": l2}


def write_weights(spark: SparkSession, weights: dict, path: str) -> None:
    """Write learned weights as JSON where ``path`` says, on any file system Spark knows."""
    import json

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(json.dumps(weights, indent=2).encode()))
    finally:
        out.close()


def perplexity_mapping(df: DataFrame, l2: float = 0.0) -> dict | None:
    """Midpoint and steepness of a falling logistic in perplexity; None if it doesn't fall."""
    m = fit_logistic(df, ["score"], l2=l2)
    c = m["weights"]["score"]
    return {"midpoint": -m["bias"] / c, "steepness": -1 / c, "n": m["trained_on"]} if c < 0 else None


def load_weights(text: str) -> dict | None:
    """Learned weights from JSON text; None unless finite and not all zero."""
    import json

    try:
        raw = json.loads(text)
        weights = {str(k): float(v) for k, v in raw["weights"].items()}
        bias = float(raw.get("bias", 0.0))
    except (ValueError, TypeError, KeyError, AttributeError):
        return None
    values = [bias, *weights.values()]
    if not weights or not all(map(math.isfinite, values)) or not any(weights.values()):
        return None
    return {"bias": bias, "weights": weights, "trained_on": raw.get("trained_on", 0)}
