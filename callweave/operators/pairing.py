"""Pairing of key sets: outer joins with a rule for repeats, censuses, audits, checked lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_by_key(a: DataFrame, b: DataFrame, key: str, a_value: str, b_value: str) -> DataFrame:
    """Full outer pairing; of several rows with one key the greatest value stands for the key."""
    x = a.groupBy(key).agg(F.max(a_value).alias(a_value))
    y = b.groupBy(key).agg(F.max(b_value).alias(b_value))
    return x.join(y, key, "full")


def pair_census(pairs: DataFrame, a_value: str, b_value: str) -> DataFrame:
    l, r = F.col(a_value).isNotNull(), F.col(b_value).isNotNull()
    return pairs.agg(F.count_if(l & r).alias("matched"), F.count_if(l & ~r).alias("left_only"), F.count_if(~l & r).alias("right_only"), F.count(F.lit(1)).alias("keys"))


def multiplicity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Per key how often each side has it, and what that means for pairing."""
    x = a.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
    y = b.groupBy(key).agg(F.count(F.lit(1)).alias("n_right"))
    j = x.join(y, key, "full").select(key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    state = (
        F.when((F.col("n_left") == 1) & (F.col("n_right") == 1), "unique")
        .when(F.col("n_left") == 0, "right_only")
        .when(F.col("n_right") == 0, "left_only")
        .otherwise("ambiguous")
    )
    return j.withColumn("state", state)


def unique_pairs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join restricted to keys that either side has exactly once."""
    once = lambda d: d.join(d.groupBy(key).count().where("count = 1").select(key), key, "left_semi")
    return once(a).join(once(b), key)


def ordered_left_join(left: DataFrame, right: DataFrame, key: str, position: str) -> DataFrame:
    """A left join that carries the left row's position; sort by it where the rows are written."""
    return left.select(position, *[c for c in left.columns if c != position]).join(right, key, "left")


def interval_jobs(parents: DataFrame, children: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """One row a parent with its intervals as a sorted list."""
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e")))).alias("intervals"))
    return parents.join(lists, key)


def missing_keys(a: DataFrame, b: DataFrame, key: str, issue: str) -> DataFrame:
    """Issue rows for keys of a that b lacks."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("issue", F.lit(issue))


def only_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_semi")


def resolve(local: DataFrame, archive: DataFrame, key: Sequence[str], digest: str = "sha256") -> DataFrame:
    """Which copy serves each file: local, archive, both alike or both different."""
    x = local.select(*key, F.col(digest).alias("_l"))
    y = archive.select(*key, F.col(digest).alias("_r"))
    state = F.when(F.col("_r").isNull(), "local_only").when(F.col("_l").isNull(), "archive_only").when(F.col("_l") == F.col("_r"), "same").otherwise("different")
    return x.join(y, list(key), "full").select(*key, state.alias("state"))


def consistent_features(tables: Sequence[DataFrame], key: str, agree: Sequence[str]) -> DataFrame:
    """Several feature tables joined on a key, with ``mismatch``: the first column on which they disagree."""
    first = tables[0].select(key, *[F.col(c).alias(f"{c}_0") for c in agree])
    wrong: Column = F.lit(None).cast("string")
    for i, t in enumerate(tables[1:], 1):
        first = first.join(t.select(key, *[F.col(c).alias(f"{c}_{i}") for c in agree]), key)
        for c in reversed(agree):
            wrong = F.when(~F.col(f"{c}_0").eqNullSafe(F.col(f"{c}_{i}")), c).otherwise(wrong)
    return first.withColumn("mismatch", wrong)


def key_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def shared_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().exceptAll(b.select(key).distinct())


def same_sets(a: DataFrame, b: DataFrame, key: str) -> bool:
    return key_difference(a, b, key).isEmpty() and key_difference(b, a, key).isEmpty()


def merged_counts(parts: Sequence[DataFrame], key: str, n: str = "n") -> DataFrame:
    """Counts of several tables added up."""
    out = parts[0].select(key, n)
    for p in parts[1:]:
        out = out.unionByName(p.select(key, n))
    return out.groupBy(key).agg(F.sum(n).alias(n))


def migrate_log(old: DataFrame, new: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows to append to ``new`` from ``old``: wanted keys that it lacks. Rows of one key that differ are an error
    for the caller: see :func:`log_conflicts`."""
    return old.join(wanted.select(key).distinct(), key, "left_semi").join(new.select(key), key, "left_anti").dropDuplicates([key])


def log_conflicts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    cols = [c for c in new.columns if c != key]
    x, y = old.select(key, F.struct(*cols).alias("_o")), new.select(key, F.struct(*cols).alias("_n"))
    return x.join(y, key).where(~F.col("_o").eqNullSafe(F.col("_n"))).select(key).distinct()
