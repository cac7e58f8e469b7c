"""Interval union, gaps, overlap and coverage per entity, in integer milliseconds.

Rows without a usable span (a time missing, a negative start, an end not after the start) are left out everywhere.
Null entities form one entity of their own. Repeated rows and ties change nothing; an empty table gives an empty
result. Extra columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.operators.ordered import BUCKET, KEY, keyed, null_safe_join, value_ranks


def usable(start: str = "startAt", end: str = "endAt") -> Column:
    """Both times present, start at or after zero, end after start."""
    return F.coalesce((F.col(start) >= 0) & (F.col(end) > F.col(start)), F.lit(False))


def _spans(df: DataFrame, entity: list[str], start: str, end: str) -> DataFrame:
    return df.where(usable(start, end)).select(*entity, F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"))


def gaps(df: DataFrame, entity: list[str], start: str = "startAt", end: str = "endAt", min_gap: int = 1, width: int = 600_000) -> DataFrame:
    """The holes between the continuous periods of each entity: ``gap_start``, ``gap_end``; touching spans are
    continuous. Starts and ends are ranked independently: there is a hole after the k-th smallest end exactly if
    the (k+1)-th smallest start lies beyond it. Both sides are joined on (entity, k), which spreads a large entity
    over all tasks."""
    s = _spans(df, entity, start, end)
    starts = value_ranks(s, entity, "_s", width).where("before > 0").select(*entity, F.col("before").alias("_k"), F.col("value").alias("gap_end"))
    ends = value_ranks(s, entity, "_e", width).select(*entity, F.col("through").alias("_k"), F.col("value").alias("gap_start"))
    return (
        null_safe_join(starts, ends, [*entity, "_k"])
        .where((F.col("gap_end") > F.col("gap_start")) & (F.col("gap_end") - F.col("gap_start") >= min_gap))
        .select(*entity, "gap_start", "gap_end")
    )


def periods(df: DataFrame, entity: list[str], start: str = "startAt", end: str = "endAt", width: int = 600_000) -> DataFrame:
    """The continuous periods of each entity: ``period_no`` from 1, ``period_start``, ``period_end``. Spans of one start
    are one row, its latest end. A start opens a period if it lies beyond every earlier end: the greatest of those in its
    bucket of ``width`` is a running maximum, that of all earlier buckets one row a bucket. A period ends with the
    greatest end before the next opening; numbers and ends that lie in other buckets also come by one row a bucket, so
    spans are shuffled to (entity, bucket) once and an entity of any size is spread."""
    s = keyed(_spans(df, entity, start, end), entity, "_s", width).groupBy(KEY, BUCKET, "_s").agg(F.max("_e").alias("_e"))
    inside, earlier = Window.partitionBy(KEY, BUCKET).orderBy("_s"), Window.partitionBy(KEY).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    run = s.withColumn("_run", F.max("_e").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    tops = s.groupBy(KEY, BUCKET).agg(F.max("_e").alias("_top")).select(KEY, BUCKET, F.max("_top").over(earlier).alias("_carry"))
    before = run.join(tops, [KEY, BUCKET]).select(KEY, BUCKET, "_s", "_e", F.greatest("_run", "_carry").alias("_before"))
    opens = F.col("_before").isNull() | (F.col("_s") > F.col("_before"))
    opened = before.where(opens).drop("_e")
    opened = opened.withColumn("_i", F.row_number().over(inside)).withColumn("_end", F.lead("_before").over(inside))
    after = Window.partitionBy(KEY).orderBy(BUCKET).rowsBetween(1, Window.unboundedFollowing)
    buckets = opened.groupBy(KEY, BUCKET).agg(F.count(F.lit(1)).alias("_n"), F.min_by("_before", "_s").alias("_first"))
    ends = s.groupBy(KEY).agg(F.max("_e").alias("_last"))
    across = buckets.select(
        KEY,
        BUCKET,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
        F.first("_first", ignorenulls=True).over(after).alias("_next"),
    ).join(ends, KEY)
    return opened.join(across, [KEY, BUCKET]).select(
        *[F.col(KEY)[c].alias(c) for c in entity],
        (F.col("_base") + F.col("_i")).cast("bigint").alias("period_no"),
        F.col("_s").alias("period_start"),
        F.coalesce("_end", "_next", "_last").alias("period_end"),
    )


def union_small(df: DataFrame, entity: list[str], start: str, end: str) -> DataFrame:
    """Merged intervals by a running maximum; one task an entity, for entities of bounded size."""
    by = Window.partitionBy(*entity).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.coalesce((F.col(start) > before).cast("int"), F.lit(1)))
    island = marked.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*entity, "_island").agg(F.min(start).alias("start_ms"), F.max(end).alias("end_ms")).drop("_island")


def bucketed_overlap(a: DataFrame, b: DataFrame, entity: list[str], s: str = "start_ms", e: str = "end_ms", width: int = 60_000) -> DataFrame:
    """Total overlap per entity of two sets of disjoint intervals, for entities of any size: both sides are listed under
    every bucket of ``width`` that they touch, joined on (entity, bucket), and a pair counts in each bucket only what lies
    in it. Disjoint intervals in a bucket of bounded width are few."""

    def listed(d: DataFrame, p: str) -> DataFrame:
        first, last = F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)
        x = d.select(*entity, F.col(s).alias(f"{p}s"), F.col(e).alias(f"{p}e"), F.explode(F.sequence(first, last)).alias("_b"))
        return x.withColumn(f"{p}s", F.greatest(f"{p}s", F.col("_b") * width)).withColumn(f"{p}e", F.least(f"{p}e", (F.col("_b") + 1) * width))

    j = listed(a, "_a").join(listed(b, "_c"), [*entity, "_b"])
    return j.where("_as < _ce and _cs < _ae").groupBy(*entity).agg(F.sum(F.least("_ae", "_ce") - F.greatest("_as", "_cs")).alias("overlap_ms"))
