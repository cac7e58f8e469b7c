"""Models: fitted on one part, applied to the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import evaluate, ml, sampling
from callweave.queries.registry import query, table
from callweave.session import durable


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings").where("label is not null and size(embedding) = 64").select("vec_id", "embedding", "label").withColumn("id", F.col("vec_id").cast("string")).withColumn("y", (F.col("label") % 2).cast("double"))
    e = sampling.hash_split(e.withColumn("stratum", F.col("label").cast("string")), "stratum", "id")
    return durable(ml.as_vector(e, "embedding").select("vec_id", "id", "embedding", "features", "label", "y", "partition"), "vectors")


def _none(spark, v, schema):
    """An empty result where there is nothing to train on."""
    return spark.createDataFrame([], schema) if v.where("partition = 'train'").isEmpty() else None


@query("logistic_regression")
def logistic_regression(spark, sf):
    v = _vectors(spark, sf)
    if (empty := _none(spark, v, "vec_id bigint, y double, p double")) is not None:
        return empty
    m = ml.logistic(v.where("partition = 'train'"), "y", 0.1)
    p = ml.probability(m, v.where("partition <> 'train'"))
    return p.select("vec_id", "y", F.round("p", 6).alias("p"))


@query("rbf_machine")
def rbf_machine(spark, sf):
    """An approximated RBF machine: random Fourier features and a linear SVM; accuracy on the held-out part."""
    v = _vectors(spark, sf)
    if (empty := _none(spark, v, "n bigint, accuracy double")) is not None:
        return empty
    f = ml.fourier_features(v.drop("features"), "embedding", 64, ml.scale_gamma(v.where("partition = 'train'"), "embedding"))
    m = ml.rbf_svc(f.where("partition = 'train'"), "y", 10.0)
    return evaluate.accuracy(m.transform(f.where("partition <> 'train'")), "y", "prediction")


@query("cross_validation")
def cross_validation(spark, sf):
    """Out-of-fold predictions of all vectors."""
    v = _vectors(spark, sf)
    if (empty := _none(spark, v, "vec_id bigint, fold int, y double, p double")) is not None:
        return empty
    v = sampling.folds(v.withColumn("stratum", F.col("label").cast("string")), "stratum", "id", 3)
    v = durable(v, "folds")
    oof = ml.cross_validate(v, "fold", "id", lambda t: ml.logistic(t, "y", 0.1), lambda m, t: ml.probability(m, t))
    return oof.select("vec_id", "fold", "y", F.round("p", 6).alias("p"))


@query("one_vs_rest")
def one_vs_rest(spark, sf):
    """One binary model a label value; macro F1 over labels on the held-out part."""
    v = _vectors(spark, sf)
    if (empty := _none(spark, v, "label string, precision double, recall double, f1 double, support bigint, predicted_positive bigint")) is not None:
        return empty
    values = [r[0] for r in v.select("label").distinct().orderBy("label").collect()]
    names = [f"y{x}" for x in values]
    v = v.select("vec_id", "features", "partition", *[(F.col("label") == x).cast("int").alias(n) for x, n in zip(values, names)])
    models = ml.one_vs_rest(v.where("partition = 'train'"), names, 1.0)
    out = None
    for n, m in models.items():
        p = ml.probability(m, v.where("partition <> 'train'")).select("vec_id", F.lit(n).alias("label"), F.col(n).alias("y"), evaluate.decide(F.col("p"), 0.5).alias("d"))
        out = p if out is None else out.unionByName(p)
    return evaluate.precision_recall(out, "label", "y", "d")
