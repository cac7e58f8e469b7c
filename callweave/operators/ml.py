"""Preparation and models: statistics come from the training rows only, models from Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.operators.checks import enforce
from callweave.operators.stats import exact_quantiles


def train_statistics(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """One row: median, mean and population deviation of every column over the training rows. Deviation and mean
    are those after missing values are replaced by the median."""
    x = {c: F.when(train, F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))) for c in columns}
    long = df.where(train).select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), x[c].alias("v")) for i, c in enumerate(columns)])).alias("z")).select("z.*")
    q = exact_quantiles(long, ["c"], "v", [0.5])
    med = q.agg(*[F.max(F.when(F.col("c") == i, F.col("quantile"))).alias(f"{c}_median") for i, c in enumerate(columns)])
    filled = df.where(train).join(F.broadcast(med)).select(*[F.coalesce(x[c], F.col(f"{c}_median")).alias(c) for c in columns])
    rest = filled.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return med.join(F.broadcast(rest))


def impute_scale(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """Missing values become the training median; then (x - mean) / deviation of the training rows, a constant
    column only centred."""
    s = train_statistics(df, columns, train)
    out = {c: (F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.col(f"{c}_median")) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std")) for c in columns}
    return df.join(F.broadcast(s)).select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def as_vector(df: DataFrame, columns: Sequence[str] | str, out: str = "features") -> DataFrame:
    """Columns, or one array column, as an ML vector."""
    a = F.col(columns).cast("array<double>") if isinstance(columns, str) else F.array(*[F.col(c).cast("double") for c in columns])
    return df.withColumn(out, array_to_vector(a))


def logistic(train: DataFrame, label: str, c: float = 1.0, features: str = "features", max_iter: int = 100):
    """L2 logistic regression with the loss summed and weighted by C: regParam = 1 / (C n), no inner scaling."""
    n = train.count()
    enforce("no training rows" if n == 0 else None)
    return LogisticRegression(featuresCol=features, labelCol=label, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-6).fit(train)


def probability(model, df: DataFrame, out: str = "p") -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def one_vs_rest(train: DataFrame, labels: Sequence[str], c: float = 1.0) -> dict[str, object]:
    """One binary model a label, as labels do not exclude each other. ``train`` is read once a label: store it."""
    return {x: logistic(train.withColumn("_y", F.col(x).cast("double")), "_y", c) for x in labels}


def fourier_features(df: DataFrame, vector: str, size: int, gamma: float, n: int = 256, seed: int = 42, out: str = "features") -> DataFrame:
    """Random Fourier features of an RBF kernel: with a linear SVM an approximation of the kernel machine."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (size, n)), rng.uniform(0, 2 * np.pi, n)

    @F.pandas_udf("array<double>")
    def lift(s):
        return type(s)(list(np.sqrt(2 / n) * np.cos(np.vstack(s.to_numpy()).astype(float) @ w + b)))

    return df.withColumn(out, array_to_vector(lift(F.col(vector))))


def scale_gamma(df: DataFrame, vector: str) -> float:
    """1 / (number of features x variance over all values)."""
    r = df.select(F.size(vector).alias("d"), F.explode(vector).alias("x")).agg(F.max("d"), F.var_pop("x")).first()
    return 1.0 / (r[0] * r[1])


def rbf_svc(train: DataFrame, label: str, c: float = 1.0, features: str = "features"):
    n = train.count()
    return LinearSVC(featuresCol=features, labelCol=label, regParam=1 / (c * n), standardization=False, maxIter=200).fit(train)


def cross_validate(df: DataFrame, fold: str, id: str, fit: Callable[[DataFrame], object], predict: Callable[[object, DataFrame], DataFrame], done: Sequence[int] = ()) -> DataFrame | None:
    """Out-of-fold predictions, one fold held out at a time; folds in ``done`` are skipped. An id in two folds is
    leakage."""
    twice = df.groupBy(id).agg(F.count_distinct(fold).alias("n")).where("n > 1").limit(1).count()
    enforce("leakage: an id lies in two folds" if twice else None)
    out = None
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        if k in done:
            continue
        p = predict(fit(df.where(F.col(fold) != k)), df.where(F.col(fold) == k))
        out = p if out is None else out.unionByName(p)
    return out


def quadratic_projection(seconds: float, rows: int, target: int) -> float:
    """Seconds that a method of quadratic cost will take on ``target`` rows."""
    return seconds * (target / rows) ** 2


def realtime_projection(seconds: float, audio_seconds: float, total_audio_seconds: float, limit_hours: float = 12.0) -> tuple[float, bool]:
    """Hours for all audio at the measured rate, and whether that is within the limit."""
    hours = seconds / audio_seconds * total_audio_seconds / 3600
    return hours, hours <= limit_hours
