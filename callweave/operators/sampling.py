"""Splits and samples by salted hashes. Ranks within a stratum are bucketed (see :mod:`ordered`), so a stratum that
holds half of all rows is ranked by all tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.scalar import salted_hash
from callweave.operators.ordered import null_safe_join, running_count

HASH_BITS = 32


def hash_rank(df: DataFrame, stratum: str, id: str, seed: str = "42", buckets: int = 256, out: str = "rank") -> DataFrame:
    """``df`` with ``out``: the place of the row among its stratum in order of the salted hash, from 1. A null
    stratum is hashed as an empty one."""
    h = salted_hash(seed, F.coalesce(F.col(stratum), F.lit("")), F.col(id))
    d = df.withColumn("_hash", h).withColumn("_h", F.conv(F.substring("_hash", 1, HASH_BITS // 4), 16, 10).cast("bigint"))
    return running_count(d, [stratum], "_h", F.lit(1), out, (1 << HASH_BITS) // buckets, ["_hash", id]).drop("_hash", "_h")


def hash_split(df: DataFrame, stratum: str, id: str, fraction: float = 0.2, seed: str = "42", names=("internal_validation", "train")) -> DataFrame:
    """``df`` with ``partition``: the first floor(n * fraction) of each stratum by hash rank are held out."""
    r = hash_rank(df, stratum, id, seed, out="_rank")
    n = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    j = null_safe_join(r, n, [stratum])
    return j.withColumn("partition", F.when(F.col("_rank") <= F.floor(F.col("_n") * fraction), names[0]).otherwise(names[1])).drop("_rank", "_n")


def folds(df: DataFrame, stratum: str, id: str, k: int, seed: str = "42") -> DataFrame:
    """``df`` with ``fold`` from 0 to k - 1, stratified."""
    return hash_rank(df, stratum, id, seed, out="_rank").withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def quartiles(df: DataFrame, by: Sequence[str], order: str, tie: Sequence[str], out: str = "quartile", width: int = 60_000) -> DataFrame:
    """Quartile 0 to 3 of the rank, every row with a rank of its own: pandas' qcut of a first-come rank. ``order`` is
    an integer column."""
    r = running_count(df, list(by), order, F.lit(1), "_rank", width, list(tie))
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    pr = F.when(F.col("_n") > 1, (F.col("_rank") - 1) / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    return null_safe_join(r, n, list(by)).withColumn(out, F.greatest(F.lit(0), F.ceil(pr * 4) - 1).cast("int")).drop("_rank", "_n")


def stratified_sample(df: DataFrame, strata: Sequence[str], id: str, k: int, seed: str = "42") -> DataFrame:
    """k rows of each stratum by hash, with the stratum's size. The limit by rank is taken before the shuffle."""
    w = Window.partitionBy(*strata).orderBy(salted_hash(seed, F.col(id)), id)
    picked = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    n = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("stratum_size"))
    return null_safe_join(picked, n, list(strata))


def representatives(df: DataFrame, by: Sequence[str], order: str, id: str, k: int, width: int = 60_000) -> DataFrame:
    """The rows at interior quantile places round((i + 0.5)(n - 1) / k), halves to even, of each group."""
    r = running_count(df, list(by), order, F.lit(1), "_rank", width, [id])
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround((i + 0.5) * (F.col("_n") - 1) / k).cast("bigint"))
    return null_safe_join(r, n, list(by)).where(F.array_contains(places, F.col("_rank") - 1)).drop("_rank", "_n")


def extremes(df: DataFrame, by: Sequence[str], low: str, high: str, id: str) -> DataFrame:
    """The id with the least ``low`` (the smallest id on a tie) and with the greatest ``high`` (the largest id)."""
    return df.groupBy(*by).agg(F.min_by(id, F.struct(low, id)).alias("least_id"), F.max_by(id, F.struct(high, id)).alias("greatest_id"))


def smoke_rows(df: DataFrame, by: Sequence[str], order: str, id: str, width: int = 60_000) -> DataFrame:
    """First, middle and last row of each group."""
    r = running_count(df, list(by), order, F.lit(1), "_rank", width, [id])
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return null_safe_join(r, n, list(by)).where("_rank in (1, _n div 2 + 1, _n)").drop("_rank", "_n")


def first_rows(df: DataFrame, id: str, k: int) -> DataFrame:
    return df.orderBy(id).limit(k)


def salted_order(df: DataFrame, id: str, salt: str) -> list[Column]:
    """Sort keys of a seeded reorder."""
    return [F.sha2(F.concat(F.lit(salt), F.col(id)), 256), F.col(id)]


def salted_positions(df: DataFrame, id: str, salt: str, buckets: int = 4096) -> DataFrame:
    """``df`` with ``position``, from 1, in the seeded order. Rows are counted in buckets of the hash, one row a bucket
    over all; no row passes through Python and no task sorts them all."""
    d = df.withColumn("_hash", salted_order(df, id, salt)[0]).withColumn("_h", F.conv(F.substring("_hash", 1, HASH_BITS // 4), 16, 10).cast("bigint"))
    return running_count(d, [], "_h", F.lit(1), "position", (1 << HASH_BITS) // buckets, ["_hash", id]).drop("_hash", "_h")


def multilabel_split(df: DataFrame, flags: Sequence[str], id: str, fraction: float, seed: str = "42", width: int = 1 << 24) -> DataFrame:
    """``df`` with ``held_out``: a part of about ``fraction`` in which every label, and every combination of labels, has
    its share. Records are laid out by the rarest label that they have, by combination, and by a salted hash; every
    1 / fraction-th is held out. Places are counted in buckets, so a combination may hold any part of the rows. ``flags``
    are 0 or 1; null counts as 0."""
    y = {f: F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags}
    total = df.agg(*[F.sum(c).alias(f) for f, c in y.items()]).first()
    rare = sorted(flags, key=lambda f: (total[f] or 0, f))
    rank = F.coalesce(*[F.when(y[f] == 1, F.lit(i)) for i, f in enumerate(rare)], F.lit(len(rare))).cast("bigint")
    combination = F.pmod(F.xxhash64(*[y[f] for f in rare]), F.lit(1 << 20))
    at = F.conv(F.substring(salted_hash(seed, F.col(id).cast("string")), 1, 8), 16, 10).cast("bigint")
    laid = df.withColumn("_o", rank * F.lit(1 << 52) + combination * F.lit(1 << 32) + at)
    placed = running_count(laid, [], "_o", F.lit(1), "_r", width, [id])
    return placed.withColumn("held_out", F.floor(F.col("_r") * fraction) > F.floor((F.col("_r") - 1) * fraction)).drop("_o", "_r")


def balanced_parts(n: Column, limit: int) -> Column:
    """Lengths of ceil(n / limit) parts that differ by at most one, the longer ones first."""
    k = F.greatest(F.lit(1), F.ceil(n / F.lit(float(limit)))).cast("int")
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: (F.floor(n / k) + (i < n % k).cast("int")).cast("bigint"))
