"""Contracts on tables: each evaluates aggregates and reports; :func:`enforce` raises with all violations at once."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """One or more contracts do not hold."""


def enforce(*violations: str | None) -> None:
    found = [v for v in violations if v]
    if found:
        raise ContractError("; ".join(found))


def key_report(df: DataFrame, key: str, attribute: str) -> DataFrame:
    """Keys that are not unique: ``duplicate`` where the attribute agrees, ``conflict`` where it does not."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce(F.col(attribute).cast("string"), F.lit("\0"))).alias("n_values"))
    return g.where("n > 1").select(key, "n", "n_values", F.when(F.col("n_values") > 1, "conflict").otherwise("duplicate").alias("status"))


def require_unique(df: DataFrame, key: str, what: str = "table") -> None:
    bad = df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(3).collect()  # a null key joins nothing
    enforce(f"{what}: key {key} is not unique, for example {bad[0][0]!r}" if bad else None)


def coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: ``key`` and ``missing_in`` (left or right)."""
    x, y = (d.select(key).distinct().withColumn(f"_{n}", F.lit(True)) for d, n in ((a, "l"), (b, "r")))
    j = x.join(y, key, "full")
    return j.where("_l is null or _r is null").select(key, F.when(F.col("_l").isNull(), "left").otherwise("right").alias("missing_in"))


def leakage(df: DataFrame, fields: Sequence[str], partition: str) -> DataFrame:
    """For every field, how many of its values lie in more than one partition. All fields in one pass."""
    pairs = df.select(partition, F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).cast("string") for f in fields]))).alias("field", "value"))
    return (
        pairs.where("value is not null")
        .groupBy("field", "value")
        .agg(F.min(partition).alias("a"), F.max(partition).alias("b"))
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("n_values"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n_leaking"))
    )


def reconcile(parent: DataFrame, child: DataFrame, key: str, pairs: Sequence[tuple[str, Column]], tolerance: float = 1e-7) -> DataFrame:
    """Parents whose stored totals differ from what their children give. ``pairs``: parent column, child aggregate."""
    c = child.groupBy(key).agg(*[a.alias(f"_c{i}") for i, (_, a) in enumerate(pairs)])
    j = parent.join(c, key, "left")
    diffs = [F.coalesce(F.abs(F.col(p) - F.coalesce(F.col(f"_c{i}"), F.lit(0))) > tolerance, F.col(p).isNotNull() != F.col(f"_c{i}").isNotNull()) for i, (p, _) in enumerate(pairs)]
    bad = F.lit(False)
    for d in diffs:
        bad = bad | d
    return j.where(bad).select(key, *[p for p, _ in pairs], *[F.col(f"_c{i}").alias(f"child_{p}") for i, (p, _) in enumerate(pairs)])


def prediction_faults(df: DataFrame, p: Sequence[str], predicted: str, classes: Sequence[str], tolerance: float = 1e-5) -> DataFrame:
    """Rows with the first fault of their prediction: not finite, out of range, sum, or not the argmax."""
    cols = [F.col(c) for c in p]
    finite = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in cols]
    all_finite, in_range, total = F.lit(True), F.lit(True), F.lit(0.0)
    for c, f in zip(cols, finite):
        all_finite, in_range, total = all_finite & f, in_range & c.between(0, 1), total + c
    best = F.lit(classes[0])
    top = cols[0]
    for c, name in zip(cols[1:], classes[1:]):
        best, top = F.when(c > top, name).otherwise(best), F.greatest(top, c)
    fault = F.when(~all_finite, "not_finite").when(~in_range, "out_of_range").when(F.abs(total - 1) > tolerance, "sum").when(~F.col(predicted).eqNullSafe(best), "argmax")
    return df.withColumn("fault", fault).where("fault is not null")


def misaligned(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys for which two tables disagree, or that one lacks."""
    x = a.select(key, F.struct(*columns).alias("_a"))
    y = b.select(key, F.struct(*columns).alias("_b"))
    return x.join(y, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)


def vector_faults(df: DataFrame, vector: str, size: int) -> DataFrame:
    v = F.col(vector)
    ok = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(~F.coalesce(ok, F.lit(False)))


def metric_gaps(measured: DataFrame, published: DataFrame, tolerance: float = 1e-15) -> DataFrame:
    """``metric, value, published`` where the two differ by more than the tolerance or one is missing."""
    m, q = measured.select("metric", "value"), published.select("metric", F.col("value").alias("published"))
    return m.join(q, "metric", "full").where(F.coalesce(F.abs(F.col("value") - F.col("published")) > tolerance, F.lit(True)))


def file_hashes(df: DataFrame) -> DataFrame:
    """``path`` and ``sha256`` of a binaryFile scan."""
    return df.select("path", F.sha2("content", 256).alias("sha256"))


def identity(df: DataFrame, settings: dict[str, str] | None = None) -> str:
    """A hash of schema and settings, stored beside a state and compared on resume."""
    text = df.schema.json() + "\n" + "\n".join(f"{k}={v}" for k, v in sorted((settings or {}).items()))
    return hashlib.sha256(text.encode()).hexdigest()


def same_identity(stored: str, now: str) -> None:
    enforce(None if stored == now else "the stored state belongs to other settings or another schema")


def checked_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", cardinality: str = "one_to_one", complete: bool = False) -> DataFrame:
    """A join whose cardinality is verified first; ``complete`` also demands that every left key has a match."""
    one_left, _, one_right = cardinality.partition("_to_")
    if one_left == "one":
        require_unique(left, key, "left")
    if one_right == "one":
        require_unique(right, key, "right")
    if complete:
        lost = left.join(right, key, "left_anti").limit(1).count()
        enforce("keys of the left table are missing on the right: cover incomplete" if lost else None)
    return left.join(right, key, how)
