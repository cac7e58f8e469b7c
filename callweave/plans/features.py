"""From recordings to an evaluated classifier: crops, segment features, call features, model, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import udfs
from callweave.operators import evaluate, ml, stats
from callweave.session import durable
from callweave.sources import files

MFCC = [f"c{i}" for i in range(26)]
ACOUSTIC = ["f0_mean", "f0_median", "rms", "zcr", "centroid"]


def segment_features(spark: SparkSession, root: str, jobs: DataFrame) -> DataFrame:
    """``path, segment, seconds`` and all features of every valid crop. ``jobs``: path and intervals in seconds. A
    recording is decoded once; samples go from UDF to UDF inside one stage and are never shuffled."""
    crops = files.crops(spark, root, jobs).where("error is null")
    f = crops.select("path", "segment", (F.col("end_s") - F.col("start_s")).alias("seconds"), udfs.mfcc_features("samples").alias("m"), udfs.acoustic_features("samples").alias("a"))
    return f.select("path", "segment", "seconds", *[F.col("m")[i].alias(c) for i, c in enumerate(MFCC)], *[F.col(f"a.{c}").alias(c) for c in ACOUSTIC], F.col("a.reliable").alias("reliable"))


def call_features(segments: DataFrame, key: str = "path") -> DataFrame:
    """Mean, median and deviation of every feature over a call's segments; pitch counts only where it is reliable."""
    clean = segments.select(key, "seconds", *[F.when(F.col("reliable") == 1, F.col(c)).alias(c) if c.startswith("f0") else F.col(c) for c in MFCC + ACOUSTIC])
    base = segments.groupBy(key).agg(F.count(F.lit(1)).alias("n_segments"), F.sum("seconds").alias("total_s"), F.avg("reliable").alias("reliable_ratio"))
    return stats.item_features(clean, key, MFCC + ACOUSTIC).join(base, key)


def fit_and_report(features: DataFrame, key: str, label: str, partition: str, c: float = 1.0, train: str = "train") -> tuple[DataFrame, DataFrame]:
    """Predictions of the held-out part and ``n, accuracy``. Imputation and scaling know the training rows only."""
    columns = [x for x, t in features.dtypes if x not in (key, label, partition) and t in ("double", "float", "bigint", "int")]
    scaled = durable(ml.as_vector(ml.impute_scale(features, columns, F.col(partition) == train), columns).select(key, label, partition, "features"), "scaled")
    model = ml.logistic(scaled.where(F.col(partition) == train).withColumn("_y", F.col(label).cast("double")), "_y", c)
    p = ml.probability(model, scaled.where(F.col(partition) != train)).select(key, label, "p", evaluate.decide(F.col("p"), 0.5).alias("prediction"))
    return p, evaluate.accuracy(p, label, "prediction")
