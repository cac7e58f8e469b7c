"""A frozen split: who is eligible, who is held out, and the report that shows the split is sound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.scalar import bin_label
from callweave.operators import checks, sampling, stats


def eligible(calls: DataFrame) -> DataFrame:
    """Calls of known gender with at least one segment and a duration."""
    return calls.where(F.col("gender").isin("M", "F") & (F.col("n_segments") > 0) & (stats.finite(F.col("total_duration")) > 0))


def frozen_split(calls: DataFrame, id: str = "call_id", fraction: float = 0.2, seed: str = "42") -> DataFrame:
    """``calls`` with ``partition``, stratified by gender. A repeated id is an error, not a silent choice."""
    report = checks.key_report(calls, id, "gender").groupBy("status").count().collect()
    found = {r["status"]: r["count"] for r in report}
    checks.enforce(*[f"{word} ids: {found[k]}" for k, word in (("duplicate", "Duplicate"), ("conflict", "Conflicting")) if k in found])
    return sampling.hash_split(calls.drop("partition"), "gender", id, fraction, seed)


def no_leakage(split: DataFrame, fields: list[str]) -> None:
    bad = checks.leakage(split, fields, "partition").where("n_leaking > 0").collect()
    checks.enforce(*[f"{r['field']} leaks {r['n_leaking']} values" for r in bad])


def split_report(split: DataFrame, a: str = "train", b: str = "internal_validation") -> DataFrame:
    """``measure, value``: sizes, shares, standardised difference of durations, largest gap of a duration bin, and the
    majority baseline. One row a measure."""
    edges = [0, 8, 16, 32, 64]
    sizes = split.groupBy("partition").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.concat(F.lit("n_"), "partition").alias("measure"), "value")
    women = split.groupBy("partition").agg(F.avg((F.col("gender") == "F").cast("double")).alias("value")).select(F.concat(F.lit("share_F_"), "partition").alias("measure"), "value")
    smd = stats.standardized_difference(split, "partition", a, b, "total_duration").select(F.lit("smd_duration").alias("measure"), F.col("smd").alias("value"))
    gap = stats.bin_gap(split, "partition", a, b, bin_label(F.col("total_duration"), edges)).select(F.lit("max_bin_gap_pp").alias("measure"), F.col("max_gap_pp").alias("value"))
    base = stats.majority_baseline(split, "partition", a, b, "gender").select(F.lit("majority_accuracy").alias("measure"), F.col("accuracy").alias("value"))
    return sizes.unionByName(women).unionByName(smd).unionByName(gap).unionByName(base)
