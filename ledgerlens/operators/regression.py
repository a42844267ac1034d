"""Regression with residual audit (§2.11).

Features are standardised by the population σ of the training rows. Linear
models are fitted by Spark ML's normal-equation solver, logistic ones
(class-balanced, L2) by Newton steps whose gradient and Hessian are sums over
the rows, one pass a step: every training row is used and none is collected.
Train/test membership comes from a stable hash of a row key, or from
``key mod 5`` where a check must repeat it in SQL. Scores are linear forms of
the raw columns, so predictions and residuals stay native expressions; AUC and
ROC counts use the distributed ranks and ordered prefix.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.clean import numeric_of
from ledgerlens.operators.gram import tree_sum
from ledgerlens.operators.ranks import attach_midranks, ordered_prefix
from ledgerlens.plans.runtime import bounded_broadcast, reliable_checkpoint

# Test share 20 % (one fold of five), seed 42, the error-%
# guard 0.001, the residual-risk multiple 2σ.
FOLDS = 5
SEED = 42
ERR_GUARD = 0.001
RISK_SIGMAS = 2.0

MAX_CLASSES = 1000      # of a stratified split
DIGIT = 12              # hash bits that a radix pass settles
NEWTON_STEPS = 100


def regression_type(df: DataFrame, y: str) -> DataFrame:
    """'logistic' when the target has exactly two distinct non-null values,
    else 'linear': (lo, hi, n_between, kind), from the extremes and a count of
    the values strictly between them; nothing is shuffled but one row."""
    v = df.select(numeric_of(df, y).alias("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("_k", F.lit(0))
    inside = v.withColumn("_k", F.lit(0)).join(bounded_broadcast(ends, 1, "extremes"), "_k").agg(
        F.count_if((F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi"))).alias("n_between")).withColumn("_k", F.lit(0))
    two = (F.col("lo") < F.col("hi")) & (F.col("n_between") == 0)
    return ends.join(bounded_broadcast(inside, 1, "count"), "_k").select(
        "lo", "hi", "n_between", F.when(two, "logistic").otherwise("linear").alias("kind"))


def train_test_split(df: DataFrame, key: str, seed: int = SEED, method: str = "hash",
                     stratify: str | None = None) -> DataFrame:
    """Adds ``is_test`` (one of five folds). ``method='hash'``: stable
    xxhash64 of the key; ``'mod'``: key mod 5 = 0 (repeatable in SQL).
    With ``stratify`` (a column of at most MAX_CLASSES classes; a null is one)
    the test rows are, within each class, the first 20 % in hash order: exact
    per-class share for a unique key, rows of one key stay together. The cut of
    each class is found by radix descent on the hash bits, so no rows are
    ordered; an error beyond MAX_CLASSES."""
    if method == "mod":
        return df.withColumn("is_test", F.pmod(F.col(key), F.lit(FOLDS)) == 0)
    h = F.xxhash64(F.col(key), F.lit(seed))
    if stratify is None:
        return df.withColumn("is_test", F.pmod(h, F.lit(FOLDS)) == 0)
    cuts = _hash_cuts(df.select(F.col(stratify).alias("c"), h.alias("h")))
    keys = df.sparkSession.createDataFrame([(c, t) for c, t in cuts.items()],
                                           T.StructType([T.StructField("_ll_c", df.schema[stratify].dataType),
                                                         T.StructField("_ll_t", T.LongType())]))
    joined = df.join(bounded_broadcast(keys, MAX_CLASSES, "cut of each class"), F.col(stratify).eqNullSafe(F.col("_ll_c")), "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce(h <= F.col("_ll_t"), F.lit(False)).alias("is_test"))


def _hash_cuts(rows: DataFrame) -> dict:
    """{class: largest hash of its first fold} of rows (c, h): radix descent.

    A pass counts each class's rows by the next DIGIT bits of the hashes that
    share the bits found so far, and keeps the bucket with the cut: classes x
    2^DIGIT counts, whatever the number of rows. The last bits are settled on
    the few distinct hashes that are left."""
    sizes = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()}
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes to stratify by")
    spark = rows.sparkSession
    # class -> (bits found, their number, rows of the fold still to place under them)
    open_ = {c: (0, 0, n // FOLDS + (n % FOLDS * 2 >= FOLDS)) for c, n in sizes.items()}
    open_ = {c: v for c, v in open_.items() if v[2]}
    cuts: dict = {}
    schema = T.StructType([rows.schema["c"], T.StructField("_bits", T.LongType()), T.StructField("_rest", T.LongType())])
    for done in range(0, 64, DIGIT):
        if not open_:
            break
        level = spark.createDataFrame([(c, b, rest) for c, (b, _, rest) in open_.items()], schema)
        level = bounded_broadcast(level.withColumnRenamed("c", "_c"), MAX_CLASSES, "open classes")
        inside = F.col("c").eqNullSafe(F.col("_c"))
        if done:
            inside = inside & (F.shiftright("h", 64 - done) == F.col("_bits"))
        per = rows.join(level, inside).groupBy("c", "_rest", F.shiftright("h", max(64 - done - DIGIT, 0)).alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        before = F.sum("n").over(Window.partitionBy("c").orderBy("b")) - F.col("n")
        at = per.withColumn("_lo", before).where((F.col("_lo") < F.col("_rest")) & (F.col("_rest") <= F.col("_lo") + F.col("n")))
        found = {r["c"]: r for r in at.collect()}       # one bucket a class
        for c, r in found.items():
            # settled: the whole bucket goes to the fold, or its rows have one hash
            if r["_rest"] == r["_lo"] + r["n"] or r["lo"] == r["hi"]:
                cuts[c] = r["hi"]
        open_ = {c: (r["b"], done + DIGIT, r["_rest"] - r["_lo"]) for c, r in found.items() if c not in cuts}
    return cuts


@dataclass
class FittedRegression:
    kind: str
    score: Callable[[DataFrame], Column]    # predicted value, or probability of the upper class, of raw feature columns
    features: list[str]
    target: str
    predictions: DataFrame   # test rows: key, actual, predicted (+ probability)
    metrics: DataFrame
    coefficients: DataFrame


def fit_regression(df: DataFrame, y: str, xs: Sequence[str], key: str, kind: str | None = None,
                   split: str = "hash", seed: int = SEED, stratify: bool = True) -> FittedRegression:
    """Fit on the training fold, score the test fold. Rows with a missing
    target or feature are dropped first. The few cleaned columns are written
    once; split, scaling, fit and scores read them. Logistic: the target's two
    values, the larger one is the positive class; an error when the training
    fold has one class or none."""
    xs = list(xs)
    cols = [F.col(key)] + [numeric_of(df, c).alias(c) for c in xs] + [numeric_of(df, y).alias("label")]
    data = reliable_checkpoint(df.select(*cols).dropna())
    if kind is None:
        kind = regression_type(data, "label").first()["kind"]
    data = train_test_split(data, key, seed, split, stratify="label" if (kind == "logistic" and stratify) else None)
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    spark = df.sparkSession
    if kind == "linear":
        coef, score, m = _fit_linear(train, test, xs)
        predictions = test.select(key, F.col("label").alias("actual"), score(test).alias("predicted"))
    else:
        coef, score, m, (lo, hi) = _fit_logistic(train, test, xs)
        p = score(test)
        predictions = test.select(key, F.col("label").alias("actual"), F.when(p > 0.5, F.lit(hi)).otherwise(F.lit(lo)).alias("predicted"),
                                  p.alias("probability"))
    metrics = spark.createDataFrame([(k, float(v)) for k, v in m.items()], "metric string, value double")
    coefs = spark.createDataFrame(coef, "term string, coef double, coef_raw double")
    coefs = coefs.withColumn("_o", F.when(F.col("term") == "intercept", 0).otherwise(1)) \
                 .orderBy("_o", F.abs("coef").desc()).drop("_o")
    return FittedRegression(kind, score, xs, y, predictions, metrics, coefs)


def _linear_form(xs: list[str], raw: Sequence[float | None], intercept: float) -> Callable[[DataFrame], Column]:
    def score(df: DataFrame) -> Column:
        out = F.lit(float(intercept))
        for x, c in zip(xs, raw):
            if c:
                out = out + F.lit(float(c)) * numeric_of(df, x)
        return out
    return score


def _fit_linear(train: DataFrame, test: DataFrame, xs: list[str]):
    """Least squares by the normal equations on standardised features (population σ)."""
    stages = [VectorAssembler(inputCols=xs, outputCol="_raw"),
              StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
              LinearRegression(featuresCol="features", labelCol="label", solver="normal", regParam=0.0)]
    model = Pipeline(stages=stages).fit(train)
    lr, std, mean = model.stages[-1], list(model.stages[1].std), list(model.stages[1].mean)
    n = lr.summary.numInstances
    raw = [c / s if s else None for c, s in zip(lr.coefficients, std)]
    start = lr.intercept - sum(r * mu for r, mu in zip(raw, mean) if r is not None)
    score = _linear_form(xs, raw, start)
    err = F.col("label") - score(test)
    e = test.agg(F.count(err).alias("n"), F.sum(err * err).alias("sse"), F.avg(F.abs(err)).alias("mae"),
                 F.var_pop("label").alias("var")).first()
    sst = (e["var"] or 0.0) * e["n"]
    m = {"r2": 1 - e["sse"] / sst if sst else float("nan"), "mae": e["mae"] if e["n"] else float("nan"),
         "rmse": (e["sse"] / e["n"]) ** 0.5 if e["n"] else float("nan")}
    shrink = math.sqrt((n - 1) / n) if n else 1.0       # the scaler divides by the sample σ
    coef = [("intercept", float(lr.intercept), float(start))] + [
        (x, float(c) * shrink, None if r is None else float(r)) for x, c, r in zip(xs, lr.coefficients, raw)]
    return coef, score, m


def newton_logistic(train: DataFrame, xs: Sequence[str], mean: Sequence[float], std: Sequence[float], positive: float,
                    weights: dict[float, float], l2: float = 1.0) -> np.ndarray:
    """(intercept, coefficients on standardised features) that minimise the
    weighted log loss plus l2/2 times the squared coefficients (the intercept
    is free). Each Newton step is one pass that adds up loss, gradient and
    Hessian over the rows; a step that does not lower the loss is halved."""
    k = len(xs)
    rows = train.select(*[F.col(x).cast("double") for x in xs], F.col("label").cast("double"))
    parts = rows.rdd.getNumPartitions()
    penalty = np.r_[0.0, np.full(k, l2)]
    mean, std = np.asarray(mean), np.asarray(std)

    def sums(theta: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((k + 3, k + 1))
            for batch in batches:
                cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(k + 1)]
                x = np.column_stack([np.ones(len(cols[0])), (np.column_stack(cols[:k]) - mean) / std])
                w = np.vectorize(weights.get, otypes=[np.float64])(cols[k]) if len(x) else np.zeros(0)
                sign = np.where(cols[k] == positive, 1.0, -1.0)
                margin = sign * (x @ theta)
                p = 1.0 / (1.0 + np.exp(np.clip(margin, -700, 700)))        # of the other class
                out[0, 0] += (w * np.logaddexp(0.0, -margin)).sum()
                out[1] -= (w * sign * p) @ x
                out[2:] += x.T @ (x * (w * p * (1 - p))[:, None])
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])
        found = tree_sum(rows.mapInArrow(partial, "sums binary"), (k + 3, k + 1), parts)
        found[0, 0] += 0.5 * penalty @ (theta * theta)
        found[1] += penalty * theta
        found[2:] += np.diag(penalty)
        return found

    theta, step = np.zeros(k + 1), np.zeros(k + 1)
    at = sums(theta)
    for _ in range(NEWTON_STEPS):
        step = np.linalg.lstsq(at[2:], -at[1], rcond=None)[0]
        if np.abs(step).max() <= 1e-12 * max(1.0, np.abs(theta).max()):
            break
        new = sums(theta + step)
        while new[0, 0] > at[0, 0] * (1 + 1e-14) and np.abs(step).max() > 1e-12:
            step = step / 2
            new = sums(theta + step)
        theta, at = theta + step, new
    return theta


def _fit_logistic(train: DataFrame, test: DataFrame, xs: list[str]):
    """Class-balanced logistic regression with an L2 penalty (C = 1) on features standardised by the population σ."""
    st = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)]).limit(3).collect()
    if len(st) != 2:
        raise ValueError("logistic regression needs two classes in the training fold")
    n = sum(r["n"] for r in st)
    lo, hi = sorted(r["label"] for r in st)
    weights = {r["label"]: n / (2.0 * r["n"]) for r in st}
    mean = [math.fsum(r[f"s{i}"] for r in st) / n for i in range(len(xs))]
    spread = train.agg(*[F.avg((F.col(x) - F.lit(mu)) ** 2).alias(f"v{i}") for i, (x, mu) in enumerate(zip(xs, mean))]).first()
    std = [math.sqrt(v) or 1.0 for v in spread]
    theta = newton_logistic(train, xs, mean, std, hi, weights)
    raw = [c / s for c, s in zip(theta[1:], std)]
    linear = _linear_form(xs, raw, theta[0] - sum(r * mu for r, mu in zip(raw, mean)))

    def score(df: DataFrame) -> Column:
        return 1.0 / (1.0 + F.exp(-linear(df)))

    p, actual = score(test), F.col("label") == hi
    # scores that differ by rounding alone are ties
    counted = reliable_checkpoint(test.groupBy(F.round(p, 12).alias("p")).agg(F.count_if(actual).alias("pos"), F.count(F.lit(1)).alias("c")))
    ranked = attach_midranks(counted, "p", "rank", weight="c")
    a = ranked.agg(F.sum("c").alias("n"), F.sum("pos").alias("n1"), F.sum(F.col("pos") * F.col("rank")).alias("r"),
                   F.sum(F.when(F.col("p") > 0.5, F.col("pos")).otherwise(F.col("c") - F.col("pos"))).alias("right")).first()
    m = {"accuracy": float("nan"), "auc": 0.5}
    if a["n"]:
        n1, n0 = a["n1"], a["n"] - a["n1"]
        m = {"accuracy": a["right"] / a["n"], "auc": (a["r"] - n1 * (n1 + 1) / 2) / (n1 * n0) if n1 and n0 else 0.5}
    coef = [("intercept", float(theta[0]), None)] + [(x, float(c), None) for x, c in zip(xs, theta[1:])]
    return coef, score, m, (lo, hi)


def residual_audit(predictions: DataFrame, key: str, k: int = 50) -> DataFrame:
    """Test rows with the largest |error|: key, actual, predicted, error,
    error_pct = error/(actual + 0.001)·100 (1 place, null where that is 0);
    top k. Ties follow the key, so pass one that is unique."""
    err = F.col("actual") - F.col("predicted")
    out = predictions.select(key, "actual", "predicted", err.alias("error"),
                             F.round(F.try_divide(err, F.col("actual") + ERR_GUARD) * 100.0, 1).alias("error_pct"))
    return out.orderBy(F.abs("error").desc(), F.col(key).asc()).limit(k)


def residual_risk(predictions: DataFrame) -> DataFrame:
    """mae, mean and σ (n−1) of residuals, threshold = 2σ, n_high and
    pct_high with |error| ≥ threshold."""
    err = F.col("actual") - F.col("predicted")
    s = predictions.agg(F.avg(F.abs(err)).alias("mae"), F.avg(err).alias("mean"), F.stddev_samp(err).alias("sigma"),
                        F.count(F.lit(1)).alias("_n"))
    s = s.withColumn("threshold", RISK_SIGMAS * F.col("sigma"))
    j = predictions.withColumn("_k", F.lit(0)).join(bounded_broadcast(s.withColumn("_k", F.lit(0)), 1, "risk"), "_k")
    c = j.groupBy("mae", "mean", "sigma", "threshold", "_n").agg(
        F.sum((F.abs(err) >= F.col("threshold")).cast("long")).alias("n_high"))
    return c.select("mae", "mean", "sigma", "threshold", "n_high", (F.try_divide("n_high", "_n") * 100.0).alias("pct_high"))


def roc_curve(predictions: DataFrame, score: str = "probability", label: str = "actual") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, highest first; running
    positive/negative counts come from the distributed ordered prefix. A rate
    whose class is absent is null."""
    per = predictions.groupBy(F.col(score).alias("threshold")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("_tp"), F.sum((F.col(label) != 1).cast("long")).alias("_fp"))
    pre = ordered_prefix(per, [("threshold", False)], {"_ctp": F.col("_tp"), "_cfp": F.col("_fp")})
    tot = per.agg(F.sum("_tp").alias("_P"), F.sum("_fp").alias("_N")).withColumn("_k", F.lit(0))
    j = pre.withColumn("_k", F.lit(0)).join(bounded_broadcast(tot, 1, "class totals"), "_k")
    return j.select("threshold", F.try_divide("_cfp", "_N").alias("fpr"), F.try_divide("_ctp", "_P").alias("tpr"))


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """(label, prediction, n)."""
    return predictions.groupBy(F.col("actual").alias("label"), F.col("predicted").alias("prediction")) \
                      .agg(F.count(F.lit(1)).alias("n"))


def score_scenarios(fit: FittedRegression, scenarios: DataFrame, mean_target: float | None = None) -> DataFrame:
    """Score a table of what-if rows with the fitted model: prediction
    (probability for logistic), and for linear models the difference and %
    against the mean target. Null where a feature is missing."""
    if fit.kind == "logistic":
        return scenarios.select("*", fit.score(scenarios).alias("probability"))
    out = scenarios.select("*", fit.score(scenarios).alias("prediction"))
    if mean_target is not None:
        out = out.withColumn("diff", F.col("prediction") - F.lit(mean_target)) \
                 .withColumn("diff_pct", F.when(F.lit(mean_target) != 0,
                                                (F.col("prediction") - F.lit(mean_target)) / F.lit(mean_target) * 100.0))
    return out
