"""Problem 5: a reproducible sample that is stable as data grows, by permanent random numbers.

An identifier gets a uniform value in [0, 1) when it is first seen; the value is stored and never drawn again. A
sample is every identifier whose value lies under the threshold of its stratum, and thresholds never fall. So a
record that was selected stays selected, and neither order, partitioning nor reruns matter: the value drawn at first
sight is a salted hash of the identifier, so even a lost store is drawn again alike.

Nulls: rows without an identifier are left out; a null stratum is one of its own. Repeated rows count once; an
identifier keeps the stratum under which it was first stored. An empty batch adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.operators.ordered import null_safe_join

STORE = "id string, stratum string, u double"


def uniform(col: Column, salt: str = "callweave-1") -> Column:
    """52 bits of a SHA-256 as a double in [0, 1): the same on every platform."""
    hexed = F.substring(F.sha2(F.concat(F.lit(salt + "\n"), col), 256), 1, 13)
    return F.conv(hexed, 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def first_sight(store: DataFrame | None, batch: DataFrame, id: str, stratum: str, order: str, salt: str = "callweave-1") -> DataFrame:
    """The rows to append to ``store`` (see STORE): identifiers of the batch that it lacks, with their value. Of
    several rows with one identifier the first in ``order`` gives the stratum."""
    rows = (
        batch.where(F.col(id).isNotNull())
        .groupBy(F.col(id).cast("string").alias("id"))
        .agg(F.min_by(F.struct(F.col(stratum).cast("string").alias("s")), F.struct(F.col(order), F.col(stratum))).alias("_s"))
        .select("id", F.col("_s.s").alias("stratum"))
    )
    if store is not None:
        rows = rows.join(store.select("id"), "id", "left_anti")
    return rows.withColumn("u", uniform(F.col("id"), salt))


def raise_thresholds(thresholds: DataFrame | None, store: DataFrame, rate: float, least: int = 0) -> DataFrame:
    """``stratum`` and ``threshold``: ``rate``, or more where fewer than ``least`` would be expected, but never less
    than before."""
    now = store.groupBy("stratum").agg(F.least(F.lit(1.0), F.greatest(F.lit(float(rate)), F.lit(float(least)) / F.count(F.lit(1)))).alias("_t"))
    if thresholds is None:
        return now.select("stratum", F.col("_t").alias("threshold"))
    return null_safe_join(now, thresholds, ["stratum"], "left").select("stratum", F.greatest("_t", F.coalesce("threshold", F.lit(0.0))).alias("threshold")).unionByName(
        null_safe_join(thresholds, now, ["stratum"], "left_anti")
    )


def select(store: DataFrame, thresholds: DataFrame) -> DataFrame:
    return null_safe_join(store, thresholds, ["stratum"]).where("u < threshold").select("id", "stratum", "u")
