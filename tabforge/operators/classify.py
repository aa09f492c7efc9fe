"""Classifier two-sample tests and downstream utility with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.cells import numeric
from tabforge.operators import ranges
from tabforge.schema import ColumnSchema

HASHED, ORDINALS, MOST_ROWS, TEST_SHARE, SEEDS = 4096, 255, 50_000, 0.3, (0, 1, 2, 3, 4)
TREES = {"maxIter": 200, "stepSize": 0.05, "maxDepth": 5, "minInstancesPerNode": 50}
RESAMPLES = 500
#: Trees of a regression split numbers at so many values at most; up to MOST_CELLS distinct rows of bins are boosted on the driver (about 40 bytes each and a feature).
BINS, MOST_CELLS = 32, 200_000
NUMBERS = ("integer", "fixed_decimal", "float", "date", "datetime")


def auc_rank_sum(df: DataFrame, score: str, label: str) -> DataFrame:
    """(n_pos, n_neg, auc): the area under the curve by the rank sum over distinct scores.

    Works on the histogram of scores, which is pre-aggregated; running counts go by ranges of the score.
    """
    hist = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).cast("long").alias("p"), F.count_if(F.col(label) == 0).cast("long").alias("n"))
    cuts = hist.agg(F.percentile_approx("s", [i / 128 for i in range(1, 128)], 1280).alias("c")).first()["c"] or []
    ranged = hist.withColumn("r", F.aggregate(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>"), F.lit(0), lambda k, c: k + (F.col("s") > c).cast("int")))
    before = ranged.groupBy("r").agg(F.sum("n").alias("t")).select("r", (F.sum("t").over(Window.partitionBy(F.lit(0)).orderBy("r")) - F.col("t")).alias("b"))
    below = F.col("b") + F.sum("n").over(Window.partitionBy("r").orderBy("s")) - F.col("n")
    one = ranged.join(F.broadcast(before), "r").select("p", "n", below.alias("below")).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"))
    return one.select("n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"))


def _linear_view(df: DataFrame, train: DataFrame, schema: Sequence[ColumnSchema]) -> DataFrame:
    """Imputed and standardised numbers and tokens of categories, by statistics of the training rows."""
    numbers = [c for c in schema if c.kind in NUMBERS]
    stats = train.agg(*(e for c in numbers for e in (F.percentile(numeric(F.col(c.name), c), F.lit(0.5)).alias(f"m_{c.name}"), F.avg(numeric(F.col(c.name), c)).alias(f"a_{c.name}"), F.stddev_pop(numeric(F.col(c.name), c)).alias(f"s_{c.name}")))).first() if numbers else {}
    own: dict[str, Column] = {}
    for c in numbers:
        m, a, s = stats[f"m_{c.name}"] or 0.0, stats[f"a_{c.name}"] or 0.0, stats[f"s_{c.name}"] or 0.0
        own[c.name] = (F.coalesce(numeric(F.col(c.name), c), F.lit(m)) - a) / (s or 1.0)
    for c in schema:
        if c.kind in ("categorical", "boolean"):
            own[c.name] = F.coalesce(F.col(c.name).cast("string"), F.lit("\0missing"))
    return df.select(*(e.alias(n) for n, e in own.items()), *([F.col("__label")] if "__label" in df.columns else []))


def _tree_view(df: DataFrame, train: DataFrame, schema: Sequence[ColumnSchema]) -> DataFrame:
    """Numbers with the median for nulls; categories as codes of the training rows' top values, one code for others and nulls."""
    from tabforge.operators.pairs import tops_of

    numbers, categories = [c for c in schema if c.kind in NUMBERS], [c.name for c in schema if c.kind in ("categorical", "boolean")]
    medians = train.agg(*(F.percentile(numeric(F.col(c.name), c), F.lit(0.5)).alias(c.name) for c in numbers)).first() if numbers else {}
    tops = tops_of(train, categories, ORDINALS) if categories else {}
    own = {c.name: F.coalesce(numeric(F.col(c.name), c), F.lit(medians[c.name] or 0.0)) for c in numbers}
    for c in categories:
        own[c] = F.coalesce(F.array_position(F.array(*map(F.lit, tops[c])), F.col(c).cast("string")), F.lit(0)).cast("double") if tops[c] else F.lit(0.0)
    return df.select(*(e.alias(n) for n, e in own.items()), *([F.col("__label")] if "__label" in df.columns else []))


def _auc(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Areas under the curve of counts of both labels by rising score, along the last axis."""
    return ((np.cumsum(n, -1) - n / 2) * p).sum(-1) / (p.sum(-1) * n.sum(-1))


def _interval(runs: list[tuple[np.ndarray, np.ndarray]], resamples: int = RESAMPLES) -> tuple[float, float]:
    """The 95 % bootstrap interval of the mean area: each label's rows are drawn again within each run, on its histogram of scores."""
    draw = np.random.default_rng(0)
    means = [np.mean([_auc(*(draw.multinomial(int(h.sum()), h / h.sum()) for h in run)) for run in runs]) for _ in range(resamples)]
    return float(np.quantile(means, 0.025)), float(np.quantile(means, 0.975))


def c2st(real_train: DataFrame, first: DataFrame, second: DataFrame, schema: Sequence[ColumnSchema], kind: str = "linear", seeds: Sequence[int] = SEEDS, most: int = MOST_ROWS) -> DataFrame:
    """(kind, auc, n, low, high): mean area under the curve of telling two tables apart, with its bootstrap interval; 0.5 means that
    they cannot be.

    Preparation is fitted on real training rows only.  Both sides are cut to equal size, at most ``most`` rows; fewer than four a side give
    null.  Thirty in a hundred rows, by hash, test each seed's fit; seeds are fitted side by side.
    """
    spark = real_train.sparkSession
    used = [c for c in schema if c.role == "model" and c.kind in (*NUMBERS, "categorical", "boolean")]
    n = min(first.count(), second.count(), most)
    if n < 4:
        return spark.createDataFrame([(kind, None, n, None, None)], "kind string, auc double, n long, low double, high double")
    side = lambda df, label: df.select(*(F.col(c.name) for c in used)).orderBy(F.xxhash64(*(F.col(c.name) for c in used))).limit(n).withColumn("__label", F.lit(float(label)))
    both = side(first, 1).unionByName(side(second, 0))
    view = (_linear_view if kind == "linear" else _tree_view)(both, real_train, used).persist()
    names = [c.name for c in used]

    def run(seed: int) -> tuple[np.ndarray, np.ndarray]:
        u = F.pmod(F.xxhash64(*map(F.col, names), F.col("__label"), F.lit(seed)), F.lit(1000)) / 1000
        fit, test = view.where(u >= TEST_SHARE), view.where(u < TEST_SHARE)
        if kind == "linear":
            steps = [FeatureHasher(inputCols=names, outputCol="__x", numFeatures=HASHED), LogisticRegression(featuresCol="__x", labelCol="__label", maxIter=100, regParam=1.0 / max(1, n), standardization=False)]
        else:
            steps = [VectorAssembler(inputCols=names, outputCol="__x"), GBTClassifier(featuresCol="__x", labelCol="__label", seed=seed, **TREES)]
        scores = Pipeline(stages=steps).fit(fit).transform(test).select(vector_to_array("rawPrediction")[1].alias("s"), "__label")
        hist = scores.groupBy("s").agg(F.sum("__label").cast("long").alias("p"), F.sum(1 - F.col("__label")).cast("long").alias("n")).toPandas().sort_values("s")
        return hist["p"].to_numpy(), hist["n"].to_numpy()

    view.count()
    with ThreadPoolExecutor(max(1, len(seeds))) as pool:
        runs = list(pool.map(run, seeds))
    view.unpersist()
    runs = [r for r in runs if r[0].sum() and r[1].sum()]  # few rows may leave one label alone among the test rows
    auc, (low, high) = (float(np.mean([_auc(*r) for r in runs])), _interval(runs)) if runs else (None, (None, None))
    return spark.createDataFrame([(kind, auc, n, low, high)], "kind string, auc double, n long, low double, high double")


def _split(x: np.ndarray, grad: np.ndarray, n: np.ndarray, rows: np.ndarray, least: int) -> tuple[float, int, int] | None:
    """(gain, feature, code): the split of some cells into codes up to ``code`` and beyond with the greatest loss of squares."""
    best, total, count = None, grad[rows].sum(), n[rows].sum()
    for j in range(x.shape[1]):
        size = int(x[:, j].max()) + 1
        g, m = (np.cumsum(np.bincount(x[rows, j], v[rows], size))[:-1] for v in (grad, n))
        ok = (m >= least) & (count - m >= least)
        if ok.any():
            gain = np.where(ok, g**2 / np.maximum(m, 1) + (total - g) ** 2 / np.maximum(count - m, 1) - total**2 / count, -np.inf)
            at = int(np.argmax(gain))
            if gain[at] > 1e-12 * max(1.0, abs(total)) and (best is None or gain[at] > best[0]):
                best = (float(gain[at]), j, at)
    return best


def boosted(x: np.ndarray, n: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Predictions at cells t of trees boosted for squared errors on cells x (codes of bins) with n rows each and y the sum of their labels.

    As Spark's GBTRegressor on rows: the first tree has weight 1, later ones fit twice the residuals and have weight ``stepSize``.
    """
    here, there = np.zeros(len(x)), np.zeros(len(t))
    for i in range(TREES["maxIter"]):
        grad = y if i == 0 else 2 * (y - n * here)
        weight = 1.0 if i == 0 else TREES["stepSize"]
        waiting = [(np.arange(len(x)), np.arange(len(t)), 0)]
        step = np.zeros(len(x))
        while waiting:
            rows, tests, depth = waiting.pop()
            found = _split(x, grad, n, rows, TREES["minInstancesPerNode"]) if depth < TREES["maxDepth"] else None
            if found is None:
                value = weight * grad[rows].sum() / n[rows].sum()
                step[rows] = value
                there[tests] += value
            else:
                _, j, at = found
                a, b = x[rows, j] <= at, t[tests, j] <= at
                waiting += [(rows[a], tests[b], depth + 1), (rows[~a], tests[~b], depth + 1)]
        here += step
    return there


def _boosted_rmse(fit: DataFrame, test: DataFrame, names: Sequence[str]) -> float | None:
    """The root mean square error on test rows of trees fitted on all rows of fit.

    Trees split on bins only (between a number's ``BINS`` quantiles, exact, or between its values where these are fewer), so rows of equal bins count together: one aggregation a table, then
    boosting over its cells on the driver.  Where bins have over MOST_CELLS distinct rows, Spark's trees are fitted on the rows.
    """
    fit = fit.persist()
    few = {c: [r[0] for r in fit.select(F.col(f"`{c}`")).distinct().limit(BINS + 1).collect()] for c in names}
    found = ranges.quantiles_of(fit, {c: F.col(f"`{c}`") for c, v in few.items() if len(v) > BINS}, [i / BINS for i in range(1, BINS)])
    found |= {c: sorted(v)[:-1] for c, v in few.items() if len(v) <= BINS}  # few values are told apart one by one
    code = lambda c: F.array_size(F.filter(F.array(*(F.lit(float(v)) for v in sorted(set(found[c] or [0.0])))), lambda v: v < F.col(f"`{c}`")))
    cells = lambda df: df.select(*(code(c).alias(f"b{i}") for i, c in enumerate(names)), "__label").groupBy(*(f"b{i}" for i in range(len(names)))).agg(F.count("__label").alias("n"), F.sum("__label").alias("y"), F.sum(F.col("__label") ** 2).alias("yy"))
    got = [[tuple(r) for r in cells(df).limit(MOST_CELLS + 1).collect()] for df in (fit, test)]
    fit.unpersist()
    if any(len(g) > MOST_CELLS for g in got):
        steps = [VectorAssembler(inputCols=[*names], outputCol="__x"), GBTRegressor(featuresCol="__x", labelCol="__label", seed=0, **TREES)]
        return Pipeline(stages=steps).fit(fit).transform(test).agg(F.sqrt(F.avg((F.col("prediction") - F.col("__label")) ** 2))).first()[0]
    if not got[1]:
        return None
    k = len(names)
    (x, a), (t, b) = ((np.array([r[:k] for r in g], int).reshape(len(g), k), np.array([r[k:] for r in g], float)) for g in got)
    p = boosted(x, a[:, 0], a[:, 1], t)
    return float(np.sqrt(max(0.0, (b[:, 2] - 2 * p * b[:, 1] + p**2 * b[:, 0]).sum()) / b[:, 0].sum()))


def downstream(train: DataFrame, synthetic: DataFrame, holdout: DataFrame, schema: Sequence[ColumnSchema], target: str, task: str) -> DataFrame:
    """(task, source, metric, value, reason): train on real and on synthetic rows, test on holdout rows.

    Accuracy for a classification target, root mean square error for a regression target.  Test rows of classes that a source never had are
    left out.  Where a fit makes no sense, value is null and the reason says why.
    """
    spark = train.sparkSession
    used = [c for c in schema if c.role == "model" and c.name != target and c.kind in (*NUMBERS, "categorical", "boolean")]
    column = next((c for c in schema if c.name == target), None)
    out = []
    for name, rows in (("real", train), ("synthetic", synthetic)):
        reason = "unknown_target" if column is None else "no_features" if not used else "wrong_task" if task not in ("classification", "regression") else None
        if reason is None and (task == "regression") != (column.kind in NUMBERS):
            reason = "wrong_task"
        known = rows.where(F.col(target).isNotNull()) if reason is None else None
        if reason is None and known.limit(4).count() < 4:
            reason = "too_few_rows"
        if reason is None and task == "classification":
            classes = [r[0] for r in known.groupBy(target).count().orderBy(F.desc("count"), target).limit(ORDINALS).collect()]
            reason = "one_class" if len(classes) < 2 else None
        metric = "rmse" if task == "regression" else "accuracy"
        if reason is not None:
            out.append((task, name, metric, None, reason))
            continue
        y = F.col(target).cast("double") if task == "regression" else (F.array_position(F.array(*map(F.lit, classes)), F.col(target)) - 1).cast("double")
        tests = holdout.where(F.col(target).isNotNull()).withColumn("__label", y)
        view = _tree_view if task == "regression" else _linear_view
        fit, test = view(known.withColumn("__label", y), known, used), view(tests.where("__label >= 0") if task == "classification" else tests, known, used)
        names = [c.name for c in used]
        if task == "regression":
            out.append((task, name, metric, _boosted_rmse(fit, test, names), None))
            continue
        steps = [FeatureHasher(inputCols=names, outputCol="__x", numFeatures=HASHED), LogisticRegression(featuresCol="__x", labelCol="__label", maxIter=100, regParam=1e-4, standardization=False)]
        value = F.avg((F.col("prediction") == F.col("__label")).cast("double"))
        out.append((task, name, metric, Pipeline(stages=steps).fit(fit.where("__label >= 0")).transform(test).agg(value).first()[0], None))
    return spark.createDataFrame(out, "task string, source string, metric string, value double, reason string")
