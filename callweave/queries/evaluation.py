"""Evaluation of classifiers. Truth comes from the tables, scores are reproducible hashes of the ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.functions import scalar
from callweave.operators import checks, evaluate, stats
from callweave.queries.distributions import _FLAGS, _HOT, hot
from callweave.queries.pairing import _PART, ONE_LABEL, one_call
from callweave.queries.registry import query


def score(id: Column, salt: str) -> Column:
    """A reproducible score in [0, 1]."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt), id), 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)


def _score(id: str, salt: str) -> str:
    return f"(CAST(('0x' || substr(sha256('{salt}' || {id}), 1, 8)) AS BIGINT) / 4294967295.0)"


def calls(spark, sf):
    """Calls of known gender with the predictions of three models; a score leans towards the truth."""
    c = one_call(spark, sf).where("gender in ('F', 'M')").select("call_id", "gender", "partition", "n_segments", "total_duration")
    t = F.when(F.col("gender") == "M", 0.25).otherwise(-0.25)
    for m in ("a", "b", "c"):
        c = c.withColumn(f"p_{m}", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score(F.col("call_id"), m) + t))).withColumn(m, F.when(F.col(f"p_{m}") >= 0.5, "M").otherwise("F"))
    return c


_CALLS = (
    "(SELECT *, "
    + ", ".join(f"CASE WHEN p_{m} >= 0.5 THEN 'M' ELSE 'F' END AS {m}" for m in "abc")
    + " FROM (SELECT call_id, gender, partition, n_segments, total_duration, "
    + ", ".join(f"least(1.0, greatest(0.0, {_score('call_id', m)} + CASE WHEN gender = 'M' THEN 0.25 ELSE -0.25 END)) AS p_{m}" for m in "abc")
    + f" FROM {_PART} WHERE gender IN ('F', 'M')))"
)


def labels(spark, sf):
    """Long rows of the multi-label task: call, label, truth and two scores."""
    h = hot(spark, sf)
    long = h.select("call_id", F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in _FLAGS]), F.array(*[F.col(f) for f in _FLAGS]))).alias("label", "y"))
    k = F.concat("label", "call_id")
    return long.select("call_id", "label", "y", ((score(k, "x") + F.col("y")) / 2).alias("px"), ((score(k, "y") * 2 + F.col("y")) / 3).alias("py"))


_LABELS = f"(SELECT call_id, label, y, ({_score('label || call_id', 'x')} + y) / 2 AS px, ({_score('label || call_id', 'y')} * 2 + y) / 3 AS py FROM (UNPIVOT (SELECT call_id, {_HOT} FROM {ONE_LABEL}) ON {', '.join(_FLAGS)} INTO NAME label VALUE y))"


def _rounded(df, *names):
    return df.select(*[F.round(c, 9).alias(c) if c in names else F.col(c) for c in df.columns])


@query("confusion", f"SELECT gender, count(*) FILTER (a = 'F') AS F, count(*) FILTER (a = 'M') AS M FROM {_CALLS} GROUP BY gender")
def confusion(spark, sf):
    return evaluate.confusion(calls(spark, sf), "gender", "a", ["F", "M"])


@query("accuracy", f"SELECT count(*) AS n, round(avg(CAST(gender = a AS INTEGER)), 9) AS accuracy FROM {_CALLS}")
def accuracy(spark, sf):
    return _rounded(evaluate.accuracy(calls(spark, sf), "gender", "a"), "accuracy")


@query("accuracy_by_group", f"SELECT g AS bin, count(c.call_id) AS n, round(avg(CAST(c.gender = c.a AS INTEGER)), 9) AS accuracy FROM (SELECT unnest(['[1,6)', '[6,11)', '[11,21)', '[21,41)', '[41,1000)', '[1000,inf)']) AS g) LEFT JOIN (SELECT *, CASE WHEN n_segments < 1 THEN NULL WHEN n_segments < 6 THEN '[1,6)' WHEN n_segments < 11 THEN '[6,11)' WHEN n_segments < 21 THEN '[11,21)' WHEN n_segments < 41 THEN '[21,41)' WHEN n_segments < 1000 THEN '[41,1000)' ELSE '[1000,inf)' END AS bin FROM {_CALLS} WHERE n_segments IS NOT NULL) c ON c.bin = g GROUP BY g")
def accuracy_by_group(spark, sf):
    """Accuracy by number of segments; a bin without calls has n = 0 and no accuracy."""
    edges = [1, 6, 11, 21, 41, 1000]
    names = [f"[{a},{b})" for a, b in zip(edges, [*edges[1:], "inf"])]
    c = calls(spark, sf).withColumn("bin", scalar.bin_label(F.col("n_segments"), edges))
    return _rounded(stats.group_metric(c, "bin", spark.createDataFrame([(n,) for n in names], "bin string"), F.col("gender") == F.col("a")), "accuracy")


_PRF = f"(SELECT label, count(*) FILTER (y = 1 AND px >= 0.5) tp, count(*) FILTER (y = 0 AND px >= 0.5) fp, count(*) FILTER (y = 1 AND px < 0.5) fn FROM {_LABELS} GROUP BY label)"


def _prf(spark, sf):
    return evaluate.precision_recall(labels(spark, sf).withColumn("d", evaluate.decide(F.col("px"), 0.5)), "label", "y", "d")


@query("precision_recall", f"SELECT label, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, tp + fn AS support, tp + fp AS predicted_positive FROM {_PRF}")
def precision_recall(spark, sf):
    return _rounded(_prf(spark, sf), "precision", "recall", "f1")


@query("macro_f1", f"SELECT round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 9) AS macro_f1 FROM {_PRF}")
def macro_f1(spark, sf):
    return _rounded(evaluate.macro_f1(_prf(spark, sf)), "macro_f1")


_G91 = "(SELECT i, 0.05::DOUBLE + i * ((0.05::DOUBLE + 0.01::DOUBLE) - 0.05::DOUBLE) AS t FROM range(91) r(i))"


@query(
    "threshold_sweep_f1",
    f"WITH s AS (SELECT label, i, t, count(*) FILTER (y = 1 AND px >= t) tp, count(*) FILTER (y = 0 AND px >= t) fp, count(*) FILTER (y = 1 AND px < t) fn FROM {_LABELS}, {_G91} GROUP BY ALL), f AS (SELECT *, coalesce(2.0::DOUBLE * tp / nullif(2.0::DOUBLE * tp + fp + fn, 0), 0) AS f FROM s) SELECT label, round(t, 9) AS threshold, round(f, 9) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY f DESC, i) = 1",
)
def threshold_sweep_f1(spark, sf):
    return _rounded(evaluate.sweep_f1(labels(spark, sf), ["label"], "y", "px"), "threshold", "f1")


@query(
    "threshold_sweep_accuracy",
    f"WITH g AS (SELECT 0.2::DOUBLE + i * ((0.2::DOUBLE + 0.005::DOUBLE) - 0.2::DOUBLE) AS t FROM range(121) r(i)), s AS (SELECT t, count(*) FILTER ((p_a >= t) = (gender = 'M')) / count(*) AS acc FROM {_CALLS}, g GROUP BY t) SELECT round(t, 9) AS threshold, round(acc, 9) AS accuracy FROM s ORDER BY acc DESC, abs(t - 0.5), t LIMIT 1",
)
def threshold_sweep_accuracy(spark, sf):
    c = calls(spark, sf).withColumn("y", (F.col("gender") == "M").cast("int"))
    return _rounded(evaluate.sweep_accuracy(c, "y", "p_a"), "threshold", "accuracy")


@query(
    "blend_sweep",
    f"WITH w AS (SELECT i AS wi, i * 0.05::DOUBLE AS w FROM range(21) r(i)), b AS (SELECT wi, w, label, y, px * w + py * (1 - w) AS p FROM {_LABELS}, w), s AS (SELECT wi, w, label, i, count(*) FILTER (y = 1 AND p >= t) tp, count(*) FILTER (y = 0 AND p >= t) fp, count(*) FILTER (y = 1 AND p < t) fn FROM b, {_G91} GROUP BY ALL), f AS (SELECT wi, w, label, max(coalesce(2.0::DOUBLE * tp / nullif(2.0::DOUBLE * tp + fp + fn, 0), 0)) AS f FROM s GROUP BY ALL), m AS (SELECT wi, w, avg(f) AS m FROM f GROUP BY ALL) SELECT w AS weight, round(m, 9) AS macro_f1 FROM m ORDER BY round(m, 12) DESC, wi LIMIT 1",
)
def blend_sweep(spark, sf):
    return _rounded(evaluate.sweep_blend(labels(spark, sf), "label", "y", "px", "py"), "macro_f1")


@query("model_overlap", f"SELECT count(*) FILTER (a = gender AND b = gender) AS both_correct, count(*) FILTER (a <> gender AND b = gender) AS corrected, count(*) FILTER (a = gender AND b <> gender) AS regressed, count(*) FILTER (a <> gender AND b <> gender) AS both_wrong FROM {_CALLS}")
def model_overlap(spark, sf):
    return evaluate.model_overlap(calls(spark, sf), "gender", "a", "b")


@query("all_wrong", f"SELECT count(*) FILTER (a <> gender AND b <> gender AND c <> gender) AS all_wrong, count(*) FILTER (a <> gender AND (b = gender OR c = gender)) AS fixed_by_any FROM {_CALLS}")
def all_wrong(spark, sf):
    return evaluate.all_wrong(calls(spark, sf), "gender", ["a", "b", "c"], "a")


@query(
    "cohorts",
    f"WITH c AS (SELECT *, gender <> a AS w FROM {_CALLS}), g AS (SELECT 'short' AS cohort, w FROM c WHERE total_duration < 60 UNION ALL SELECT 'few_segments', w FROM c WHERE n_segments < 10 UNION ALL SELECT 'female', w FROM c WHERE gender = 'F') SELECT cohort, count(*) AS n, CAST(sum(CAST(w AS INTEGER)) AS BIGINT) AS n_wrong, round(avg(CAST(w AS INTEGER)), 9) AS rate, round(sum(CAST(w AS INTEGER)) / (SELECT sum(CAST(w AS INTEGER)) FROM c), 9) AS share FROM g GROUP BY cohort",
)
def cohorts(spark, sf):
    c = calls(spark, sf)
    members = {"short": F.col("total_duration") < 60, "few_segments": F.col("n_segments") < 10, "female": F.col("gender") == "F"}
    return _rounded(stats.cohorts(c, members, F.col("gender") != F.col("a")), "rate", "share")


@query(
    "prediction_faults",
    f"SELECT call_id, fault FROM (SELECT call_id, CASE WHEN p > 1 OR q > 1 THEN 'out_of_range' WHEN abs(p + q - 1) > 1e-5 THEN 'sum' WHEN a <> CASE WHEN p > q THEN 'M' ELSE 'F' END THEN 'argmax' END AS fault FROM (SELECT call_id, a, CASE WHEN total_duration < 40 THEN p_a + 1 ELSE p_a END AS p, CASE WHEN n_segments > 30 THEN 1.01 - p_a ELSE 1 - p_a END AS q FROM (SELECT call_id, total_duration, n_segments, p_a, CASE WHEN p_b >= 0.5 THEN a ELSE 'M' END AS a FROM {_CALLS}))) WHERE fault IS NOT NULL",
)
def prediction_faults(spark, sf):
    c = calls(spark, sf).withColumn("a", F.when(F.col("p_b") >= 0.5, F.col("a")).otherwise("M"))
    c = c.withColumn("q", F.when(F.col("n_segments") > 30, 1.01 - F.col("p_a")).otherwise(1 - F.col("p_a"))).withColumn("p", F.when(F.col("total_duration") < 40, F.col("p_a") + 1).otherwise(F.col("p_a")))
    return checks.prediction_faults(c, ["q", "p"], "a", ["F", "M"]).select("call_id", "fault")


@query("probability_blend", f"SELECT call_id, round(p_a * 0.3 + p_b * 0.7, 9) AS p, CAST(p_a * 0.3::DOUBLE + p_b * 0.7::DOUBLE >= 0.535 AS INTEGER) AS decision FROM {_CALLS}")
def probability_blend(spark, sf):
    c = calls(spark, sf).withColumn("p", evaluate.blend("p_a", "p_b", 0.3))
    return c.select("call_id", F.round("p", 9).alias("p"), evaluate.decide(F.col("p"), 0.535).alias("decision"))


@query("error_types", f"SELECT label, err, count(*) AS n FROM (SELECT label, CASE WHEN y = 1 AND px < 0.7 THEN 'FN' WHEN y = 0 AND px >= 0.7 THEN 'FP' END AS err FROM {_LABELS}) WHERE err IS NOT NULL GROUP BY 1, 2")
def error_types(spark, sf):
    e = scalar.error_type(F.col("y"), evaluate.decide(F.col("px"), 0.7))
    return labels(spark, sf).select("label", e.alias("err")).where("err is not null").groupBy("label", "err").agg(F.count(F.lit(1)).alias("n"))


@query("best_model", f"SELECT arg_max(m, (x, m)) AS model, round(max(x), 9) AS metric FROM (SELECT unnest(['a', 'b', 'c']) AS m, unnest([avg(CAST(a = gender AS INTEGER)), avg(CAST(b = gender AS INTEGER)), avg(CAST(c = gender AS INTEGER))]) AS x FROM {_CALLS})")
def best_model(spark, sf):
    c = calls(spark, sf)
    long = c.select(F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in "abc"]), F.array(*[(F.col(m) == F.col("gender")).cast("double") for m in "abc"]))).alias("model", "r"))
    return _rounded(evaluate.best_model(long.groupBy("model").agg(F.avg("r").alias("x")), "model", "x"), "metric")


@query("fold_summary", f"WITH f AS (SELECT CAST(CAST(('0x' || substr(sha256('f' || call_id), 1, 4)) AS BIGINT) % 3 AS INTEGER) AS fold, unnest(['a', 'b', 'c']) AS model, unnest([a, b, c]) AS p, gender FROM {_CALLS}), g AS (SELECT model, fold, avg(CAST(p = gender AS INTEGER)) acc, sum(CAST(p <> gender AS INTEGER)) e FROM f GROUP BY 1, 2) SELECT model, count(*) AS n_folds, round(avg(acc), 9) AS mean, round(min(acc), 9) AS min, round(max(acc), 9) AS max, CAST(sum(e) AS BIGINT) AS errors FROM g GROUP BY model HAVING count(*) = 3")
def fold_summary(spark, sf):
    c = calls(spark, sf).withColumn("fold", (F.conv(F.substring(F.sha2(F.concat(F.lit("f"), "call_id"), 256), 1, 4), 16, 10).cast("bigint") % 3).cast("int"))
    long = c.select("fold", "gender", F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in "abc"]), F.array(*[F.col(m) for m in "abc"]))).alias("model", "p"))
    g = long.groupBy("model", "fold").agg(F.avg((F.col("p") == F.col("gender")).cast("double")).alias("acc"), F.sum((F.col("p") != F.col("gender")).cast("int")).alias("e"))
    return _rounded(stats.fold_summary(g, "model", "acc", "e", 3), "mean", "min", "max")
