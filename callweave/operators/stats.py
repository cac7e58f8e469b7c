"""Counts, distributions and group statistics. Quantiles are exact, with linear interpolation; values that are not
finite are left out of statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.operators.ordered import null_safe_join


def finite(x: Column) -> Column:
    """The value, or null where it is missing, NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def value_counts(df: DataFrame, column: str, top: int | None = None, dropna: bool = True) -> DataFrame:
    d = df.where(F.col(column).isNotNull()) if dropna else df
    c = d.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), column).limit(top) if top else c


def label_counts(df: DataFrame, labels: str, classes: DataFrame, name: str = "label") -> DataFrame:
    """How often each class occurs in a list column; classes that never occur keep a zero. ``classes`` is a dimension."""
    n = df.select(F.explode(labels).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(classes).join(n, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"))


def dense_counts(df: DataFrame, a: str, a_values: Sequence[str], b: str, b_values: Sequence[str]) -> DataFrame:
    """Counts over all combinations of two closed sets, zeros kept. The grid is built from the given values."""
    grid = df.sparkSession.createDataFrame([(x, y) for x in a_values for y in b_values], f"{a} string, {b} string")
    n = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(n, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"))


def binned_shares(df: DataFrame, by: Sequence[str], bin: Column) -> DataFrame:
    """Counts by bin and their share within the group."""
    n = df.select(*by, bin.alias("bin")).where("bin is not null").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, mean, bounds and exact quantiles of the finite values of each group, whatever its size."""
    x = finite(F.col(value))
    g = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    return with_quantiles(g, df, by, value, {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95})


def with_quantiles(groups: DataFrame, df: DataFrame, by: Sequence[str], value: str, names: dict[str, float]) -> DataFrame:
    """``groups``, one row for each ``by``, with exact quantiles of ``df``'s values; null in a group without any."""
    q = exact_quantiles(df, by, value, list(names.values()))
    wide = q.groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(c) for c, p in names.items()])
    return null_safe_join(groups, wide, list(by), "left") if by else groups.join(F.broadcast(wide))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], cells: int = 128, salts: int = 16) -> DataFrame:
    """``by, p, quantile`` with linear interpolation, exact for groups of any size. An aggregate that holds a group's
    distinct values in one place does not scale to a group with a third of all rows; here a sketch cuts each group
    into cells, rows are counted by cell, and only the few cells that hold a wanted rank are ranked, by value counts.
    The sketch only places the cells: the result does not depend on its error. Values are counted before they meet the
    cuts, and a group's cuts are there ``salts`` times, so a group with a third of all values is joined in parts."""
    x = finite(F.col(value))
    d = df.select(*by, x.alias("_x")).where("_x is not null")
    cuts = d.groupBy(*by).agg(F.percentile_approx("_x", F.array(*[F.lit(i / cells) for i in range(1, cells)]), 100 * cells).alias("_cuts"))
    cell = F.size(F.filter("_cuts", lambda c: c < F.col("_x")))
    counts = d.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_n"))
    if by:
        salted = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        placed = null_safe_join(counts.withColumn("_salt", F.pmod(F.xxhash64("_x"), F.lit(salts))), salted, [*by, "_salt"])
    else:
        placed = counts.join(F.broadcast(cuts))
    counted = placed.select(*by, cell.alias("_cell"), "_x", "_n")
    size = counted.groupBy(*by, "_cell").agg(F.sum("_n").alias("_m"))
    w = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    size = size.select(*by, "_cell", "_m", F.coalesce(F.sum("_m").over(w), F.lit(0)).alias("_below"))
    total = size.groupBy(*by).agg(F.sum("_m").alias("_all"))
    want = (null_safe_join(size, total, list(by)) if by else size.join(F.broadcast(total))).select(
        "*", F.explode(F.array(*[F.lit(p) for p in probabilities])).alias("p")
    )
    at = F.col("p") * (F.col("_all") - 1)
    want = want.withColumn("_at", at).withColumn("_lo", F.floor("_at")).withColumn("_hi", F.ceil("_at"))
    inside = lambda r: (F.col(r) >= F.col("_below")) & (F.col(r) < F.col("_below") + F.col("_m"))
    want = want.where(inside("_lo") | inside("_hi"))
    keys = [*by, "_cell"]
    ranked = null_safe_join(counted, want.select(*keys, "_below").distinct(), keys)
    run = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("_end", F.col("_below") + F.sum("_n").over(run)).withColumn("_start", F.col("_end") - F.col("_n")).drop("_below")
    hit = null_safe_join(ranked, want, keys)
    has = lambda r: (F.col(r) >= F.col("_start")) & (F.col(r) < F.col("_end"))
    g = hit.where(has("_lo") | has("_hi")).groupBy(*by, "p").agg(
        F.max(F.when(has("_lo"), F.col("_x"))).alias("a"), F.max(F.when(has("_hi"), F.col("_x"))).alias("b"), F.max(F.col("_at") - F.col("_lo")).alias("f")
    )
    return g.select(*by, "p", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("quantile"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, digits: int = 6) -> DataFrame:
    s = stats(df, by, value)
    return s.select(*by, *[F.bround(c, digits).alias(c) for c in ("min", "q25", "median", "q75", "q95", "max", "mean")])


def describe(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return stats(df, by, value).select(*by, "mean", "median", "min", "max")


def nested_report(df: DataFrame, split: str, group: str, matched: Column, value: str, short_ms: Sequence[int]) -> DataFrame:
    """Measures by split x scope (all, matched) x group, and by split x scope over all groups."""
    scoped = df.withColumn("scope", F.explode(F.when(matched, F.array(F.lit("all"), F.lit("matched"))).otherwise(F.array(F.lit("all")))))
    v = F.col(value)
    agg = [
        F.count(F.lit(1)).alias("n"),
        F.sum(v).alias("total"),
        F.avg(v).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        *[F.count_if(v < t).alias(f"below_{t}") for t in short_ms],
    ]
    report = scoped.groupingSets([[split, "scope", group], [split, "scope"]], split, "scope", group).agg(F.grouping(group).cast("int").alias("all_groups"), *agg)
    each = scoped.select(split, "scope", group, F.explode(F.array(F.lit(0), F.lit(1))).alias("all_groups"), v.alias("_value"))
    each = each.withColumn(group, F.when(F.col("all_groups") == 0, F.col(group)))
    return with_quantiles(report, each, [split, "scope", group, "all_groups"], "_value", {"median": 0.5})


def short_counts(df: DataFrame, by: Sequence[str], value: str, limits: Sequence[int]) -> DataFrame:
    """Strictly below each limit; the counts are nested."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(value) < t).alias(f"below_{t}") for t in limits])


def shares(df: DataFrame, by: Sequence[str], **conditions: Column) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c.cast("double")).alias(n) for n, c in conditions.items()])


def standardized_difference(df: DataFrame, partition: str, a: str, b: str, value: str) -> DataFrame:
    """(mean b - mean a) / sqrt of the mean of the two sample variances; 0 where that is 0."""
    x = finite(F.col(value))
    in_ = lambda p: F.when(F.col(partition) == p, x)
    m = df.agg(F.avg(in_(a)).alias("ma"), F.avg(in_(b)).alias("mb"), F.var_samp(in_(a)).alias("va"), F.var_samp(in_(b)).alias("vb"))
    pooled = F.sqrt((F.col("va") + F.col("vb")) / 2)
    return m.select(F.when(pooled == 0, F.lit(0.0)).otherwise((F.col("mb") - F.col("ma")) / pooled).alias("smd"))


def bin_gap(df: DataFrame, partition: str, a: str, b: str, bin: Column) -> DataFrame:
    """The largest difference of a bin's share between two partitions, in percentage points; null if one is empty."""
    n = df.where(F.col(partition).isin(a, b)).select(partition, bin.alias("bin")).where("bin is not null")
    c = n.groupBy("bin").agg(F.count_if(F.col(partition) == a).alias("na"), F.count_if(F.col(partition) == b).alias("nb"))
    t = c.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    return c.join(F.broadcast(t)).agg(F.max(F.abs(F.try_divide("na", "ta") - F.try_divide("nb", "tb")) * 100).alias("max_gap_pp"))


def majority_baseline(df: DataFrame, partition: str, train: str, test: str, label: str) -> DataFrame:
    """The commonest label in one partition (the larger on a tie) and how often it is right in another."""
    c = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count_if(F.col(partition) == train).alias("n_train"), F.count_if(F.col(partition) == test).alias("n_test"))
    return c.agg(
        F.max_by(label, F.struct("n_train", label)).alias("majority"),
        F.try_divide(F.max_by("n_test", F.struct("n_train", label)), F.sum("n_test")).alias("accuracy"),
    )


def id_duplicates(df: DataFrame, fields: Sequence[str], split: str) -> DataFrame:
    """For every id field: values, values that repeat, rows in excess, values in several splits."""
    long = df.select(split, F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).cast("string") for f in fields]))).alias("field", "value")).where("value is not null")
    v = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.min(split).alias("a"), F.max(split).alias("b"))
    return v.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.sum(F.col("n") - 1).alias("n_excess"),
        F.count_if(F.col("a") != F.col("b")).alias("n_across"),
    )


def staged_duplicates(df: DataFrame, id: str, cheap: str, edges: Column, full: Column) -> DataFrame:
    """Groups of exact copies by a cascade: rows of which the cheap key and the edge hash repeat, and only of those the
    full hash. ``id`` of every copy with its digest. What is shuffled first is keys and hashes; contents are only
    joined to the ids that are left, which AQE broadcasts while they are few."""
    repeated = lambda d, keys: d.join(d.groupBy(*keys).count().where("count > 1").drop("count"), keys, "left_semi")
    keys = df.where(F.col(cheap).isNotNull()).select(id, F.col(cheap).alias("_cheap"), edges.alias("_edge"))
    left = repeated(keys, ["_cheap", "_edge"]).select(id).distinct()
    return repeated(df.join(left, id, "left_semi").select(id, full.alias("digest")), ["digest"])


def text_duplicates(df: DataFrame, text: str, split: str) -> DataFrame:
    """By split: texts, rows in excess of the distinct texts, empty ones."""
    return df.groupBy(split).agg(
        F.count(text).alias("n_texts"), (F.count(text) - F.count_distinct(text)).alias("n_excess"), F.count_if(F.trim(F.coalesce(text, F.lit(""))) == "").alias("n_empty")
    )


def label_cardinality(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    total = sum((F.col(f) for f in flags), F.lit(0))
    return df.groupBy(total.cast("bigint").alias("n_labels")).agg(F.count(F.lit(1)).alias("n"))


def label_rates(df: DataFrame, split: str, flags: Sequence[str]) -> DataFrame:
    return df.groupBy(split).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in flags])


def issue_counts(issues: DataFrame, split: str = "split", issue: str = "issue") -> DataFrame:
    """Issues by split and over all splits (``all``)."""
    g = issues.groupingSets([[split, issue], [issue]], split, issue).agg(F.grouping(split).alias("_g"), F.count(F.lit(1)).alias("n"))
    return g.select(F.when(F.col("_g") == 1, "all").otherwise(F.col(split)).alias(split), issue, "n")


def item_features(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Mean, median and population deviation of every feature over an item's rows; NaN left out, null if all are. The
    median holds an item's distinct values in one place: items are bounded (the segments of a call), groups of any size
    have :func:`exact_quantiles`."""
    out = []
    for f in features:
        x = F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
        out += [F.avg(x).alias(f"{f}_mean"), F.median(x).alias(f"{f}_median"), F.stddev_pop(x).alias(f"{f}_std")]
    return df.groupBy(key).agg(*out)


def mean_vector(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean of vectors of one length, in double precision, one row an element: ``key, pos, mean``. Vectors
    are summed as they are, not exploded; null vectors are left out."""
    v = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return v.groupBy(key).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(key, F.posexplode(vector_to_array("_m")).alias("pos", "mean"))


def weighted_mean(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("weighted_mean"))


def cohorts(df: DataFrame, members: dict[str, Column], wrong: Column) -> DataFrame:
    """Overlapping cohorts: size, errors, error rate, share of all errors. One pass; a row counts in each of its cohorts."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in members.items()]))
    e = df.select(F.explode(F.concat(F.array(F.lit("")), names)).alias("cohort"), wrong.cast("int").alias("w"))
    g = e.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("n_wrong"))
    total = g.where("cohort = ''").select(F.col("n_wrong").alias("_all"))
    return g.where("cohort <> ''").join(F.broadcast(total)).select("cohort", "n", "n_wrong", (F.col("n_wrong") / F.col("n")).alias("rate"), F.try_divide("n_wrong", "_all").alias("share"))


def group_metric(df: DataFrame, group: str, groups: DataFrame, right: Column) -> DataFrame:
    """Accuracy by group; a group without rows has n = 0 and a null accuracy."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"))
    return F.broadcast(groups).join(g, group, "left").select(group, F.coalesce("n", F.lit(0)).alias("n"), "accuracy")


def fold_summary(df: DataFrame, candidate: str, accuracy: str, errors: str, folds: int) -> DataFrame:
    """Candidates with all folds, best first."""
    g = df.groupBy(candidate).agg(F.count(F.lit(1)).alias("n_folds"), F.avg(accuracy).alias("mean"), F.min(accuracy).alias("min"), F.max(accuracy).alias("max"), F.sum(errors).alias("errors"))
    return g.where(F.col("n_folds") == folds).orderBy(F.desc("mean"), F.desc("min"), candidate)


def class_weights(df: DataFrame, flags: Sequence[str], lo: float = 1.0, hi: float = 3.0) -> DataFrame:
    """sqrt(negatives / positives), clipped, for every flag."""
    long = df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in flags]), F.array(*[F.col(f).cast("int") for f in flags]))).alias("label", "y"))
    g = long.groupBy("label").agg(F.sum("y").alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    return g.select("label", F.least(F.lit(hi), F.greatest(F.lit(lo), F.coalesce(F.sqrt(F.try_divide("neg", "pos")), F.lit(hi)))).alias("weight"))


def length_limits(df: DataFrame, length: Column, limit: int) -> DataFrame:
    d = df.select(length.alias("_length"))
    over = F.col("_length") > limit
    g = d.agg(F.count_if(over).alias("n_over"), F.avg(over.cast("double")).alias("rate_over"))
    return with_quantiles(g, d, [], "_length", {"median": 0.5}).select("median", "n_over", "rate_over")


def schema_stats(walked: DataFrame, examples: int = 5, shown: int = 30) -> DataFrame:
    """Of walked documents (path, type, value): how often each path occurs, its types, its least examples and its
    number of distinct values."""
    t = walked.groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))
    types = t.groupBy("path").agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "type", F.col("n").cast("string")))), ",").alias("types"))
    v = walked.where("value is not null").groupBy("path", "value").agg(F.count(F.lit(1)).alias("c"))
    nth = v.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("value"))).where(F.col("r") <= examples)
    ex = nth.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("examples"))
    dist = v.groupBy("path").agg(F.count(F.lit(1)).alias("n_distinct"))
    return types.join(dist, "path", "left").join(ex, "path", "left").select("path", "n", "types", "examples", "n_distinct", (F.col("n_distinct") <= shown).alias("listed"))


def header_summary(headers: DataFrame) -> DataFrame:
    """Distribution of rate and channels, duration range and errors of scanned audio headers."""
    return headers.groupBy("sample_rate", "channels").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("riff_status") != "ok").alias("n_damaged"), F.min("duration_s").alias("min_s"), F.max("duration_s").alias("max_s"), F.avg("duration_s").alias("mean_s")
    )
