"""Order-dependent values (ranks, neighbours, running counts) of groups of any size.

A window over ``partitionBy(entity)`` puts a whole entity into one task. Here the order column, an integer, is cut
into buckets of fixed width; windows run inside (entity, bucket), and only one row a bucket takes part in a window
over the whole entity. Equal values are counted before anything is shuffled, so a bucket holds at most ``width``
rows however many rows share an entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"


KEY = "_key"


def bucket_of(value: str, width: int) -> Column:
    """The bucket of a value; nulls have one of their own, before all others."""
    return F.coalesce(F.floor(F.col(value) / F.lit(width)).cast("bigint"), F.lit(-(1 << 62)))


def keyed(df: DataFrame, entity: list[str], order: str, width: int) -> DataFrame:
    """``df`` with the entity as one struct, in which nulls are equal, and the bucket of ``order``. Windows and plain
    joins on the two share one partitioning, which a null-safe join on the columns would not."""
    return df.withColumns({KEY: F.struct(*entity) if entity else F.lit(0), BUCKET: bucket_of(order, width)})


def value_ranks(df: DataFrame, entity: list[str], value: str, width: int = 600_000) -> DataFrame:
    """One row for each entity and distinct ``value`` (nulls left out): ``n`` rows have it, ``before`` rows of the
    entity have a smaller one and ``through`` rows a smaller or equal one."""
    counted = (
        keyed(df.where(F.col(value).isNotNull()), entity, value, width)
        .groupBy(KEY, BUCKET, F.col(value).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    inner = counted.withColumn(
        "_in", F.sum("n").over(Window.partitionBy(KEY, BUCKET).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    )
    totals = counted.groupBy(KEY, BUCKET).agg(F.sum("n").alias("_t")).select(KEY, BUCKET, _sum_before("_t").alias("_base"))
    return (
        inner.join(totals, [KEY, BUCKET])
        .withColumn("through", F.col("_base") + F.col("_in"))
        .select(*[F.col(KEY)[e].alias(e) for e in entity], "value", "n", (F.col("through") - F.col("n")).alias("before"), "through")
    )


def _sum_before(col: str) -> Column:
    """The sum over an entity's earlier buckets."""
    return F.coalesce(F.sum(col).over(Window.partitionBy(KEY).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def previous_in_order(df: DataFrame, entity: list[str], order: str, carry: list[str], width: int = 600_000, tie: list[str] | None = None) -> DataFrame:
    """``df`` with ``prev_<c>`` for each ``c`` of ``carry``: the value in the row before it, in order of ``order``
    and then ``tie``, of the same entity. Null in an entity's first row."""
    ordering = [order, *(tie or [])]
    b = keyed(df, entity, order, width)
    packed = F.struct(*[F.col(c).alias(c) for c in carry])
    inner = b.withColumn("_prev", F.lag(packed).over(Window.partitionBy(KEY, BUCKET).orderBy(*ordering)))
    last = b.groupBy(KEY, BUCKET).agg(F.max_by(packed, F.struct(*ordering)).alias("_last"))
    across = last.select(KEY, BUCKET, F.lag("_last").over(Window.partitionBy(KEY).orderBy(BUCKET)).alias("_before"))
    src = F.coalesce(F.col("_prev"), F.col("_before"))
    return inner.join(across, [KEY, BUCKET]).select(*df.columns, *[src[c].alias(f"prev_{c}") for c in carry])


def running_count(df: DataFrame, entity: list[str], order: str, flag: Column, out: str, width: int = 600_000, tie: list[str] | None = None) -> DataFrame:
    """``df`` with ``out``: how many rows of the entity, up to and with this one, have ``flag``."""
    b = keyed(df, entity, order, width).withColumn("_f", flag.cast("bigint"))
    by = Window.partitionBy(KEY, BUCKET).orderBy(order, *(tie or []))
    inner = b.withColumn("_in", F.sum("_f").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    base = b.groupBy(KEY, BUCKET).agg(F.sum("_f").alias("_t")).select(KEY, BUCKET, _sum_before("_t").alias("_base"))
    return inner.join(base, [KEY, BUCKET]).select(*df.columns, (F.col("_base") + F.col("_in")).alias(out))


def run_numbers(df: DataFrame, entity: list[str], order: str, value: str, out: str, width: int = 600_000, tie: list[str] | None = None) -> DataFrame:
    """``df`` with ``out``: the number, from 1, of the run of equal ``value`` that the row lies in, in order of its entity.
    Rows are shuffled to their bucket once; what passes from bucket to bucket is one row each."""
    ordering = [order, *(tie or [])]
    by = Window.partitionBy(KEY, BUCKET).orderBy(*ordering)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(F.col("_i") > 1, ~F.col(value).eqNullSafe(F.col("_was"))).otherwise(F.lit(False)).cast("bigint")
    inner = keyed(df, entity, order, width).withColumns({"_was": F.lag(value).over(by), "_i": F.row_number().over(by)}).withColumn("_in", F.sum(opens).over(upto))
    at = F.struct(*ordering)
    ends = inner.groupBy(KEY, BUCKET).agg(F.max("_in").alias("_n"), F.min_by(value, at).alias("_first"), F.max_by(value, at).alias("_last"))
    across = Window.partitionBy(KEY).orderBy(BUCKET)
    ends = ends.withColumns({"_b": F.row_number().over(across), "_p": F.lag("_last").over(across)})
    ends = ends.withColumn("_opens", F.when(F.col("_b") == 1, True).otherwise(~F.col("_first").eqNullSafe(F.col("_p"))).cast("bigint"))
    base = ends.withColumn("_t", F.col("_n") + F.col("_opens")).select(KEY, BUCKET, (_sum_before("_t") + F.col("_opens")).alias("_base"))
    return inner.join(base, [KEY, BUCKET]).select(*df.columns, (F.col("_base") + F.col("_in")).alias(out))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key equals a null key; ``right``'s keys are dropped."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])
