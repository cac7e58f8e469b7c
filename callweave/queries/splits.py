"""Splits, samples and incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import scalar
from callweave.operators import ml, sampling
from callweave.queries.pairing import _PART, one_call
from callweave.queries.registry import query, table
from callweave.streaming import incremental

_H = "sha256('42' || chr(0) || coalesce(gender, '') || chr(0) || call_id)"
_RANK = f"(SELECT call_id, gender, row_number() OVER (PARTITION BY gender ORDER BY {_H}, call_id) AS rank, count(*) OVER (PARTITION BY gender) AS n FROM {_PART})"


def _calls(spark, sf):
    return one_call(spark, sf).select("call_id", "gender", "total_duration", "n_segments")


@query("hash_split", f"SELECT call_id, gender, CASE WHEN rank <= floor(n * 0.2) THEN 'internal_validation' ELSE 'train' END AS partition FROM {_RANK}")
def hash_split(spark, sf):
    return sampling.hash_split(_calls(spark, sf), "gender", "call_id").select("call_id", "gender", "partition")


@query("kfold", f"SELECT call_id, gender, CAST((rank - 1) % 3 AS INTEGER) AS fold FROM {_RANK}")
def kfold(spark, sf):
    return sampling.folds(_calls(spark, sf), "gender", "call_id", 3).select("call_id", "gender", "fold")


_M = f"(SELECT call_id, gender, CAST(round(total_duration * 1000) AS BIGINT) AS ms, n_segments FROM {_PART} WHERE total_duration IS NOT NULL AND NOT isnan(total_duration))"


def _ms(spark, sf):
    d = F.nanvl("total_duration", F.lit(None).cast("double"))
    return _calls(spark, sf).withColumn("ms", F.round(d * 1000).cast("bigint")).where("ms is not null")


@query("qcut_quartile", f"SELECT call_id, gender, CAST(greatest(0, ceil(percent_rank() OVER (PARTITION BY gender ORDER BY ms, call_id) * 4) - 1) AS INTEGER) AS quartile FROM {_M}")
def qcut_quartile(spark, sf):
    return sampling.quartiles(_ms(spark, sf), ["gender"], "ms", ["call_id"]).select("call_id", "gender", "quartile")


@query("stratified_sample", f"SELECT call_id, gender, stratum_size FROM (SELECT call_id, gender, count(*) OVER (PARTITION BY gender) AS stratum_size, row_number() OVER (PARTITION BY gender ORDER BY sha256('42' || chr(0) || call_id), call_id) AS r FROM {_PART}) WHERE r <= 5")
def stratified_sample(spark, sf):
    return sampling.stratified_sample(_calls(spark, sf), ["gender"], "call_id", 5).select("call_id", "gender", "stratum_size")


@query("representatives", f"WITH r AS (SELECT call_id, gender, row_number() OVER (PARTITION BY gender ORDER BY ms, call_id) - 1 AS r, count(*) OVER (PARTITION BY gender) AS n FROM {_M}) SELECT DISTINCT call_id, gender FROM r, range(4) g(i) WHERE r = CAST(round_even((i + 0.5::DOUBLE) * (n - 1) / 4, 0) AS BIGINT)")
def representatives(spark, sf):
    return sampling.representatives(_ms(spark, sf), ["gender"], "ms", "call_id", 4).select("call_id", "gender")


@query("extremes", f"SELECT gender, arg_min(call_id, (ms, call_id)) AS least_id, arg_max(call_id, (n_segments, call_id)) AS greatest_id FROM {_M} WHERE n_segments IS NOT NULL GROUP BY gender")
def extremes(spark, sf):
    return sampling.extremes(_ms(spark, sf).where("n_segments is not null"), ["gender"], "ms", "n_segments", "call_id")


@query("smoke_rows", f"SELECT call_id, gender FROM (SELECT call_id, gender, row_number() OVER (PARTITION BY gender ORDER BY ms, call_id) AS r, count(*) OVER (PARTITION BY gender) AS n FROM {_M}) WHERE r IN (1, n // 2 + 1, n)")
def smoke_rows(spark, sf):
    return sampling.smoke_rows(_ms(spark, sf), ["gender"], "ms", "call_id").select("call_id", "gender")


@query("first_rows", "SELECT call_id FROM mission1_manifest ORDER BY call_id LIMIT 200")
def first_rows(spark, sf):
    return sampling.first_rows(table(spark, sf, "mission1_manifest").select("call_id"), "call_id", 200)


@query("salted_order", "SELECT call_id FROM mission1_manifest ORDER BY sha256('benchmark42' || call_id), call_id LIMIT 50")
def salted_order(spark, sf):
    """The first 50 ids of the order that ``salted_positions`` has in full."""
    m = table(spark, sf, "mission1_manifest").select("call_id")
    return m.orderBy(*sampling.salted_order(m, "call_id", "benchmark42")).limit(50)


@query("salted_positions", "SELECT call_id, row_number() OVER (ORDER BY sha256('benchmark42' || call_id), call_id) AS position FROM mission1_manifest WHERE call_id IS NOT NULL")
def salted_positions(spark, sf):
    """Every id with its place in the seeded order."""
    m = table(spark, sf, "mission1_manifest").select("call_id").where("call_id is not null")
    return sampling.salted_positions(m, "call_id", "benchmark42")


@query("balanced_parts", f"WITH k AS (SELECT call_id, ms, CAST(greatest(1, ceil(ms / 15000.0::DOUBLE)) AS BIGINT) AS k FROM {_M}) SELECT call_id, CAST(i AS INTEGER) AS part, ms // k + CASE WHEN i < ms % k THEN 1 ELSE 0 END AS length FROM k, LATERAL (SELECT unnest(range(k)) AS i)")
def balanced_parts(spark, sf):
    return _ms(spark, sf).select("call_id", F.posexplode(sampling.balanced_parts(F.col("ms"), 15_000)).alias("part", "length"))


@query(
    "impute_scale",
    "WITH t AS (SELECT median(CASE WHEN NOT isnan(x) THEN x END) m FROM (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_totalprice END AS x FROM orders WHERE o_orderstatus = 'F')), f AS (SELECT o_orderkey, o_orderstatus, coalesce(CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_totalprice END, m) AS x FROM orders, t), s AS (SELECT avg(x) a, stddev_pop(x) s FROM f WHERE o_orderstatus = 'F') SELECT o_orderkey, round((x - a) / s, 7) AS x FROM f, s",
)
def impute_scale(spark, sf):
    o = table(spark, sf, "orders").withColumn("x", F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_totalprice"))).select("o_orderkey", "o_orderstatus", "x")
    return ml.impute_scale(o, ["x"], F.col("o_orderstatus") == "F").select("o_orderkey", F.round("x", 7).alias("x"))


_DONE = "substr(sha256(CAST(event_id AS VARCHAR)), 1, 1) < '8'"


@query("eta_projection", f"WITH e AS (SELECT {_DONE} AS d, value FROM events) SELECT round(sum(value) FILTER (d) / count(*) FILTER (d) * count(*) FILTER (NOT d), 4) AS eta_by_jobs, round(sum(value) FILTER (d) / sum(value) FILTER (d) * sum(value) FILTER (NOT d), 4) AS eta_by_value FROM e")
def eta_projection(spark, sf):
    e = table(spark, sf, "events").withColumn("done", F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 1) < "8")
    r = incremental.eta(e, F.col("done"), "value", ["value"])
    return r.select(*[F.round(c, 4).alias(c) for c in r.columns])


@query("status_summary", "SELECT count(*) FILTER (status = 0) AS pending, count(*) FILTER (status = 1) AS done, count(*) FILTER (status = 2) AS failed, count(*) AS total FROM call_labels")
def status_summary(spark, sf):
    return incremental.status_summary(table(spark, sf, "call_labels"))


@query("unresolved_failures", "SELECT DISTINCT b.call_id AS call_id, failed_segments FROM benchmark_calls b WHERE failed_segments > 0 AND NOT EXISTS (SELECT 1 FROM call_labels l WHERE l.call_id = b.call_id AND l.status = 1)")
def unresolved_failures(spark, sf):
    b = table(spark, sf, "benchmark_calls").where("failed_segments > 0").select("call_id", "failed_segments").distinct()
    return incremental.unresolved_failures(b, table(spark, sf, "call_labels").where("status = 1"), "call_id")


@query(
    "session_union",
    "WITH e AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 600000) AS BIGINT) * 1000 AS e FROM events WHERE round(value * 600000) > 0), w AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM e), i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM w) SELECT user_id, min(s) AS period_start, max(e) AS period_end, count(*) AS n FROM i GROUP BY user_id, k",
)
def session_union(spark, sf):
    """Union of the intervals [ts, ts + value x 600 s) of each user as session windows of dynamic gap."""
    e = table(spark, sf, "events").withColumn("ms", F.round(F.col("value") * 600_000).cast("bigint")).where("ms > 0").withColumn("ts", F.col("ts").cast("timestamp"))
    m = incremental.merged_sessions(e, "user_id", "ts", F.col("ms"))
    return m.select("user_id", F.unix_micros("period_start").alias("period_start"), F.unix_micros("period_end").alias("period_end"), "n")


@query("seeded_hash", "SELECT call_id, sha256('42' || chr(0) || call_id) AS h FROM mission1_manifest")
def seeded_hash(spark, sf):
    return table(spark, sf, "mission1_manifest").select("call_id", scalar.salted_hash("42", F.col("call_id")).alias("h"))
