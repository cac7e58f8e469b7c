"""
inputs of the same shape: `python benchmarks/published.py [cpus]`. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from callweave.functions import udfs  # noqa: E402
from callweave.operators import ml  # noqa: E402
from callweave.session import durable, get_spark  # noqa: E402

RATE = 8000


def timed(df) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main(cpus: str = "8", segments: int = 20_000, calls: int = 22_388, width: int = 768) -> None:
    spark = get_spark("published", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    # segments of 0.5 to 3.5 s: a tone with noise, as reproducible arrays
    n = (F.lit(RATE // 2) + F.pmod(F.xxhash64("id"), F.lit(3 * RATE))).cast("int")
    wave = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.sin(i * (100 + F.col("id") % 200) * 6.283 / RATE) * 0.3 + (F.hash(i, F.col("id")) % 1000) * 1e-5).cast("float"))
    seg = durable(spark.range(0, segments, 1, 4 * int(cpus)).select("id", wave.alias("x")), "segments")
    out = {"segments": segments}
    for name, f in (("log_mel", udfs.log_mel_features), ("mfcc", udfs.mfcc_features), ("acoustic", udfs.acoustic_features)):
        s = timed(seg.select("id", f("x").alias("f")))
        out[f"{name}_ms_per_segment"] = round(1000 * s / segments, 3)
        out[f"{name}_hours_442639_segments"] = round(442_639 * s / segments / 3600, 3)
    vec = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: ((F.hash(F.col("id"), i) % 1000) / 1000.0 + F.col("y") * (i % 5 == 0).cast("double") * 0.2).cast("float"))
    rows = spark.range(0, calls, 1, int(cpus)).withColumn("y", (F.col("id") % 2).cast("double"))
    emb = durable(ml.as_vector(rows.select("id", "y", vec.alias("v")), "v").select("y", "features"), "embeddings").cache()
    emb.count()
    began = time.perf_counter()
    ml.logistic(emb, "y", 0.1)
    out[f"logistic_fit_s_{calls}x{width}"] = round(time.perf_counter() - began, 2)
    print(json.dumps(out))


if __name__ == "__main__":
    main(*sys.argv[1:])
