"""Classifier evaluation: confusion, F1, threshold and blend sweeps, overlap of models.

Sweeps never multiply rows by thresholds: a score is reduced to the number of thresholds it reaches, rows are counted
by that number, and running sums over at most a few hundred counts give every threshold's figures exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid(start: float, step: float, n: int) -> list[float]:
    """The float grid start, start + step, ... with the step that the sum start + step - start gives."""
    delta = (start + step) - start
    return [start + i * delta for i in range(n)]


F1_GRID = grid(0.05, 0.01, 91)
ACCURACY_GRID = grid(0.2, 0.005, 121)
WEIGHT_GRID = [i * 0.05 for i in range(21)]


def reached(p: Column, thresholds: Sequence[float]) -> Column:
    """How many of the evenly spaced, ascending thresholds the score reaches; 0 for a null score, all for NaN. The
    place is computed and then put right by one where rounding moved it, so no list is walked for each row."""
    n, t = len(thresholds), F.array(*[F.lit(x) for x in thresholds])
    if n == 1:
        return F.coalesce((p >= thresholds[0]).cast("int"), F.lit(0))
    step = (thresholds[-1] - thresholds[0]) / (n - 1)
    k = F.greatest(F.lit(0.0), F.least(F.lit(float(n)), F.floor((p - thresholds[0]) / step) + 1)).cast("int")
    k = k + F.coalesce((F.get(t, k) <= p).cast("int"), F.lit(0)) - F.coalesce(((k > 0) & (F.get(t, F.greatest(k - 1, F.lit(0))) > p)).cast("int"), F.lit(0))
    return F.when(F.isnan(p), F.lit(n)).otherwise(F.coalesce(k, F.lit(0)))


def confusion(df: DataFrame, truth: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    return df.groupBy(truth).pivot(predicted, list(classes)).count().fillna(0)


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def precision_recall(df: DataFrame, label: str, truth: str, predicted: str) -> DataFrame:
    """Long rows (label, 0/1 truth, 0/1 prediction): precision, recall, F1, support, predicted positives."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    c = df.groupBy(label).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    return c.select(
        label,
        F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)).alias("recall"),
        f1_of(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
        (F.col("tp") + F.col("fp")).alias("predicted_positive"),
    )


def macro_f1(prf: DataFrame) -> DataFrame:
    return prf.agg(F.avg("f1").alias("macro_f1"))


def _cumulative(df: DataFrame, by: Sequence[str], truth: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """By group and threshold number (1..n): positives and rows at or above, and totals. Counts first, then sums."""
    c = df.groupBy(*by, reached(F.col(score), thresholds).alias("k")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count(F.lit(1)).alias("rows"))
    dense = c.groupBy(*by).agg(F.collect_list(F.struct("k", "pos", "rows")).alias("c"), F.sum("pos").alias("all_pos"), F.sum("rows").alias("all_rows"))
    steps = dense.select("*", F.posexplode(F.array(*[F.lit(t) for t in thresholds])).alias("i", "threshold"))
    above = F.filter(F.col("c"), lambda x: x["k"] > F.col("i"))
    add = lambda f: F.aggregate(above, F.lit(0).cast("bigint"), lambda a, x: a + x[f])
    return steps.select(*by, "i", "threshold", "all_pos", "all_rows", add("pos").alias("tp"), add("rows").alias("called"))


def sweep_f1(df: DataFrame, by: Sequence[str], truth: str, score: str, thresholds: Sequence[float] = F1_GRID) -> DataFrame:
    """The threshold with the best F1 of each group, the smallest on a tie."""
    c = _cumulative(df, by, truth, score, thresholds)
    f1 = c.select(*by, "i", "threshold", f1_of(F.col("tp"), F.col("called") - F.col("tp"), F.col("all_pos") - F.col("tp")).alias("f1"))
    best = F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("i")))
    return f1.groupBy(*by).agg(best.alias("b")).select(*by, "b.threshold", "b.f1")


def sweep_accuracy(df: DataFrame, truth: str, score: str, thresholds: Sequence[float] = ACCURACY_GRID, centre: float = 0.5) -> DataFrame:
    """The threshold with the best accuracy; on a tie the one nearest to the centre, then the smaller."""
    c = _cumulative(df.withColumn("_g", F.lit(0)), ["_g"], truth, score, thresholds)
    acc = (F.col("tp") + (F.col("all_rows") - F.col("all_pos")) - (F.col("called") - F.col("tp"))) / F.col("all_rows")
    best = F.max_by(F.struct("threshold", acc.alias("accuracy")), F.struct(acc, -F.abs(F.col("threshold") - centre), -F.col("threshold")))
    return c.agg(best.alias("b")).select("b.threshold", "b.accuracy")


def blend(a: str, b: str, weight: float) -> Column:
    return F.col(a) * F.lit(weight) + F.col(b) * F.lit(1 - weight)


def sweep_blend(df: DataFrame, label: str, truth: str, a: str, b: str, weights: Sequence[float] = WEIGHT_GRID, thresholds: Sequence[float] = F1_GRID) -> DataFrame:
    """The weight of the first model whose blend has the best mean of the labels' best F1; the first on a tie."""
    w = df.select(label, truth, a, b, F.posexplode(F.array(*[F.lit(x) for x in weights])).alias("wi", "weight"))
    p = w.withColumn("_p", F.col(a) * F.col("weight") + F.col(b) * (1 - F.col("weight")))
    best = sweep_f1(p, ["wi", "weight", label], truth, "_p", thresholds).groupBy("wi", "weight").agg(F.avg("f1").alias("macro_f1"))
    return best.agg(F.max_by(F.struct("weight", "macro_f1"), F.struct(F.round("macro_f1", 12), -F.col("wi"))).alias("b")).select("b.weight", "b.macro_f1")


def model_overlap(df: DataFrame, truth: str, old: str, new: str) -> DataFrame:
    o, n = F.col(old) == F.col(truth), F.col(new) == F.col(truth)
    return df.agg(F.count_if(o & n).alias("both_correct"), F.count_if(~o & n).alias("corrected"), F.count_if(o & ~n).alias("regressed"), F.count_if(~o & ~n).alias("both_wrong"))


def all_wrong(df: DataFrame, truth: str, predictions: Sequence[str], base: str) -> DataFrame:
    """Rows that all models miss, and rows that the base misses but any other gets."""
    right = F.array(*[F.col(p) == F.col(truth) for p in predictions])
    return df.agg(F.count_if(F.forall(right, lambda x: ~x)).alias("all_wrong"), F.count_if((F.col(base) != F.col(truth)) & F.exists(right, lambda x: x)).alias("fixed_by_any"))


def decide(p: Column, threshold: float) -> Column:
    return (p >= threshold).cast("int")


def best_model(df: DataFrame, model: str, metric: str) -> DataFrame:
    return df.agg(F.max_by(model, F.struct(metric, model)).alias("model"), F.max(metric).alias("metric"))
