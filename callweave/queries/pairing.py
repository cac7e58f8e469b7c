"""Pairing, joins, checks and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import checks, pairing
from callweave.queries.intervals import SIDE_SQL, side
from callweave.queries.registry import query, table

_LAB = "SELECT call_id, max(_id) AS label_id FROM call_labels GROUP BY call_id"
_AUD = "SELECT file_ref AS call_id, max(size_bytes) AS size_bytes FROM audio_headers GROUP BY file_ref"


def _audio(spark, sf):
    return table(spark, sf, "audio_headers").withColumnRenamed("file_ref", "call_id")


def _labels(spark, sf):
    """The label of each call, one row a call: the least by record id."""
    return table(spark, sf, "call_labels").groupBy("call_id").agg(F.min_by(F.struct("_id", "recordId", "gender", "address", "urgencyLevel", "triage", "status", "endAt", "symptom"), F.struct("_id", "recordId")).alias("r")).select("call_id", "r.*")


ONE_LABEL = "(SELECT DISTINCT ON (call_id) call_id, _id, recordId, gender, address, urgencyLevel, triage, status, endAt, symptom FROM call_labels ORDER BY call_id, _id, recordId)"


@query("pair_by_call", f"SELECT call_id, label_id, size_bytes FROM ({_LAB}) FULL JOIN ({_AUD}) USING (call_id)")
def pair_by_call(spark, sf):
    lab = table(spark, sf, "call_labels").withColumnRenamed("_id", "label_id")
    return pairing.pair_by_key(lab, _audio(spark, sf), "call_id", "label_id", "size_bytes")


@query("pair_census", f"SELECT count(*) FILTER (label_id IS NOT NULL AND size_bytes IS NOT NULL) AS matched, count(*) FILTER (size_bytes IS NULL) AS left_only, count(*) FILTER (label_id IS NULL) AS right_only, count(*) AS keys FROM ({_LAB}) FULL JOIN ({_AUD}) USING (call_id)")
def pair_census(spark, sf):
    return pairing.pair_census(pair_by_call(spark, sf), "label_id", "size_bytes")


_MULT = """WITH a AS (SELECT call_id, count(*) n FROM call_labels GROUP BY 1), b AS (SELECT file_ref AS call_id, count(*) n FROM audio_headers GROUP BY 1),
m AS (SELECT call_id, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, CASE WHEN a.n = 1 AND b.n = 1 THEN 'unique' WHEN a.n IS NULL THEN 'right_only' WHEN b.n IS NULL THEN 'left_only' ELSE 'ambiguous' END AS state FROM a FULL JOIN b USING (call_id))"""


@query("pair_multiplicity", _MULT + " SELECT state, count(*) AS n FROM m GROUP BY state")
def pair_multiplicity(spark, sf):
    return pairing.multiplicity(table(spark, sf, "call_labels"), _audio(spark, sf), "call_id").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("unique_pairs", _MULT + " SELECT l.call_id AS call_id, l._id AS _id, h.duration_s AS duration_s FROM m JOIN call_labels l USING (call_id) JOIN audio_headers h ON h.file_ref = m.call_id WHERE state = 'unique'")
def unique_pairs(spark, sf):
    return pairing.unique_pairs(table(spark, sf, "call_labels").select("call_id", "_id"), _audio(spark, sf).select("call_id", "duration_s"), "call_id")


@query("checked_one_to_one", f"SELECT m.call_id AS call_id, m.stem AS stem, l.triage AS triage FROM mission1_manifest m JOIN {ONE_LABEL} l USING (call_id)")
def checked_one_to_one(spark, sf):
    m = table(spark, sf, "mission1_manifest").select("call_id", "stem")
    return checks.checked_join(m, _labels(spark, sf).select("call_id", "triage"), "call_id")


@query("ordered_left_join", f"WITH m AS (SELECT call_id, row_number() OVER (ORDER BY call_id) AS position FROM mission1_manifest) SELECT position, m.call_id AS call_id, l.urgencyLevel AS urgency FROM m LEFT JOIN {ONE_LABEL} l USING (call_id)")
def ordered_left_join(spark, sf):
    """Manifest order is carried as a column; the ordinal comes from a range-partitioned sort, not one task."""
    m = table(spark, sf, "mission1_manifest").select("call_id").orderBy("call_id")
    numbered = m.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1] + 1)).toDF("call_id string, position bigint")
    return pairing.ordered_left_join(numbered, _labels(spark, sf).select("call_id", F.col("urgencyLevel").alias("urgency")), "call_id", "position")


@query(
    "interval_jobs",
    "SELECT m.call_id AS call_id, m.num_segments AS num_segments, u.n AS n_intervals, u.ms AS total_ms, u.first AS first_ms FROM mission1_manifest m JOIN (SELECT call_id, count(*) n, CAST(sum(e - s) AS BIGINT) ms, min(s) AS first FROM (SELECT DISTINCT call_id, id, startAt s, endAt e FROM utterances WHERE startAt >= 0 AND endAt > startAt AND " + SIDE_SQL + " = 'reporter') GROUP BY call_id) u USING (call_id)",
)
def interval_jobs(spark, sf):
    u = table(spark, sf, "utterances").where("startAt >= 0 and endAt > startAt").where(side() == "reporter").select("call_id", "id", "startAt", "endAt").distinct()
    j = pairing.interval_jobs(table(spark, sf, "mission1_manifest").select("call_id", "num_segments"), u, "call_id", "startAt", "endAt")
    total = F.aggregate("intervals", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])
    return j.select("call_id", "num_segments", F.size("intervals").cast("bigint").alias("n_intervals"), total.alias("total_ms"), F.col("intervals")[0]["s"].alias("first_ms"))


_PART = "(SELECT DISTINCT ON (lower(trim(call_id))) lower(trim(call_id)) AS call_id, partition, caller_ref, wav_relative_path, n_segments, total_duration, gender, loaded_at FROM calls ORDER BY lower(trim(call_id)), loaded_at)"


def one_call(spark, sf):
    """The first row loaded of each call."""
    c = table(spark, sf, "calls").withColumn("call_id", F.lower(F.trim("call_id")))
    keep = ["partition", "caller_ref", "wav_relative_path", "n_segments", "total_duration", "gender", "loaded_at"]
    return c.groupBy("call_id").agg(F.min_by(F.struct(*keep), "loaded_at").alias("r")).select("call_id", "r.*")


@query("segment_partition", f"SELECT coalesce(c.partition, 'none') AS partition, count(*) AS n, CAST(sum(u.endAt - u.startAt) AS BIGINT) AS ms FROM utterances u JOIN {_PART} c USING (call_id) WHERE u.startAt >= 0 AND u.endAt > u.startAt GROUP BY 1")
def segment_partition(spark, sf):
    """Every utterance inherits its call's partition; AQE splits the call that holds a tenth of the rows."""
    u = table(spark, sf, "utterances").where("startAt >= 0 and endAt > startAt").select("call_id", "startAt", "endAt")
    j = u.join(one_call(spark, sf).select("call_id", "partition"), "call_id")
    return j.groupBy(F.coalesce("partition", F.lit("none")).alias("partition")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("endAt") - F.col("startAt")).alias("ms"))


@query("semi_keys", "SELECT call_id, count(*) AS n FROM utterances u WHERE EXISTS (SELECT 1 FROM benchmark_calls b WHERE b.call_id = u.call_id) GROUP BY call_id")
def semi_keys(spark, sf):
    return pairing.only_keys(table(spark, sf, "utterances"), table(spark, sf, "benchmark_calls"), "call_id").groupBy("call_id").agg(F.count(F.lit(1)).alias("n"))


@query("anti_issues", "SELECT DISTINCT file_ref AS call_id, 'no_label' AS issue FROM audio_headers h WHERE NOT EXISTS (SELECT 1 FROM call_labels l WHERE l.call_id = h.file_ref) UNION ALL SELECT DISTINCT call_id, 'no_audio' FROM call_labels l WHERE NOT EXISTS (SELECT 1 FROM audio_headers h WHERE l.call_id = h.file_ref)")
def anti_issues(spark, sf):
    a, l = _audio(spark, sf), table(spark, sf, "call_labels")
    return pairing.missing_keys(a, l, "call_id", "no_label").unionByName(pairing.missing_keys(l, a, "call_id", "no_audio"))


@query("key_union", "SELECT call_id FROM call_labels UNION SELECT file_ref FROM audio_headers")
def key_union(spark, sf):
    return pairing.key_union(table(spark, sf, "call_labels"), _audio(spark, sf), "call_id")


@query("shared_values", "SELECT gender FROM calls INTERSECT SELECT gender FROM mission1_manifest")
def shared_values(spark, sf):
    return pairing.shared_values(table(spark, sf, "calls"), table(spark, sf, "mission1_manifest"), "gender")


@query("key_difference", "SELECT DISTINCT o_custkey AS k FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def key_difference(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return pairing.key_difference(o, o.where("o_orderstatus = 'F'"), "k")


@query("key_conflicts", "SELECT call_id, n, n_values, CASE WHEN n_values > 1 THEN 'conflict' ELSE 'duplicate' END AS status FROM (SELECT lower(trim(call_id)) AS call_id, count(*) n, count(DISTINCT coalesce(gender, chr(1))) n_values FROM calls GROUP BY 1) WHERE n > 1")
def key_conflicts(spark, sf):
    return checks.key_report(table(spark, sf, "calls").withColumn("call_id", F.lower(F.trim("call_id"))), "call_id", "gender")


@query("split_coverage", "SELECT call_id, 'right' AS missing_in FROM (SELECT call_id FROM mission1_manifest EXCEPT SELECT call_id FROM call_labels) UNION ALL SELECT call_id, 'left' FROM (SELECT call_id FROM call_labels EXCEPT SELECT call_id FROM mission1_manifest)")
def split_coverage(spark, sf):
    return checks.coverage(table(spark, sf, "mission1_manifest"), table(spark, sf, "call_labels"), "call_id")


@query(
    "leakage",
    "WITH l AS (SELECT 'caller_ref' AS field, caller_ref AS v, partition AS p FROM calls UNION ALL SELECT 'wav_relative_path', wav_relative_path, partition FROM calls UNION ALL SELECT 'call_id', call_id, partition FROM calls), g AS (SELECT field, v, min(p) a, max(p) b FROM l WHERE v IS NOT NULL GROUP BY 1, 2) SELECT field, count(*) AS n_values, count(*) FILTER (a <> b) AS n_leaking FROM g GROUP BY field",
)
def leakage(spark, sf):
    return checks.leakage(table(spark, sf, "calls"), ["caller_ref", "wav_relative_path", "call_id"], "partition")


@query(
    "reconcile_parent",
    "SELECT o_orderkey, o_totalprice, n AS child_o_totalprice FROM (SELECT o_orderkey, o_totalprice, round(sum(l_extendedprice), 2) n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) WHERE abs(o_totalprice - coalesce(n, 0)) > 200000",
)
def reconcile_parent(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return checks.reconcile(table(spark, sf, "orders"), li, "o_orderkey", [("o_totalprice", F.round(F.sum("l_extendedprice"), 2))], 200_000)


@query("segment_count_gaps", "SELECT c.call_id AS call_id, c.n_segments AS n_segments, u.n AS n_utterances FROM (SELECT call_id, n_segments FROM (SELECT DISTINCT ON (call_id) call_id, n_segments FROM benchmark_calls ORDER BY call_id, n_segments)) c JOIN (SELECT call_id, count(DISTINCT id) n FROM utterances WHERE " + SIDE_SQL + " = 'reporter' GROUP BY 1) u USING (call_id) WHERE c.n_segments <> u.n")
def segment_count_gaps(spark, sf):
    b = table(spark, sf, "benchmark_calls").groupBy("call_id").agg(F.min("n_segments").alias("n_segments"))
    u = table(spark, sf, "utterances").where(side() == "reporter").groupBy("call_id").agg(F.count_distinct("id").alias("n_utterances"))
    return b.join(u, "call_id").where("n_segments <> n_utterances")


@query("merged_counts", "SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_orderpriority AS kind, count(*) n FROM orders GROUP BY 1 UNION ALL SELECT l_returnflag, count(*) FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) GROUP BY kind")
def merged_counts(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    c = lambda d, k: d.groupBy(F.col(k).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return pairing.merged_counts([c(o, "o_orderpriority"), c(li, "l_returnflag"), c(o.where("o_orderstatus = 'O'"), "o_orderpriority")], "kind")


_OLD = "(SELECT event_id, user_id, value FROM events WHERE substr(sha256(CAST(event_id AS VARCHAR)), 1, 1) < '8')"
_NEW = "(SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN value + 1 ELSE value END AS value FROM events WHERE substr(sha256(CAST(event_id AS VARCHAR)), 1, 1) BETWEEN '4' AND 'b')"


def _logs(spark, sf):
    e = table(spark, sf, "events").withColumn("h", F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 1))
    old = e.where("h < '8'").select("event_id", "user_id", "value")
    new = e.where("h between '4' and 'b'").select("event_id", "user_id", F.when(F.col("event_type") == "error", F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    return e, old, new


@query("log_migrate", f"SELECT event_id, user_id, value FROM {_OLD} WHERE event_id IN (SELECT event_id FROM events WHERE event_type <> 'view') AND event_id NOT IN (SELECT event_id FROM {_NEW})")
def log_migrate(spark, sf):
    e, old, new = _logs(spark, sf)
    return pairing.migrate_log(old, new, e.where("event_type <> 'view'"), "event_id")


@query("log_conflicts", f"SELECT DISTINCT o.event_id AS event_id FROM {_OLD} o JOIN {_NEW} n USING (event_id) WHERE o.value <> n.value")
def log_conflicts(spark, sf):
    _, old, new = _logs(spark, sf)
    return pairing.log_conflicts(old, new, "event_id")


@query("resolve_copies", "WITH a AS (SELECT DISTINCT call_id, stem AS d FROM mission1_manifest), b AS (SELECT DISTINCT ON (call_id) call_id, recordId AS d FROM call_labels ORDER BY call_id, _id, recordId) SELECT call_id, CASE WHEN b.d IS NULL THEN 'local_only' WHEN a.d IS NULL THEN 'archive_only' WHEN split_part(a.d, '_', 1) = b.d THEN 'same' ELSE 'different' END AS state FROM a FULL JOIN b USING (call_id)")
def resolve_copies(spark, sf):
    a = table(spark, sf, "mission1_manifest").select("call_id", F.substring_index("stem", "_", 1).alias("sha256")).distinct()
    b = _labels(spark, sf).select("call_id", F.col("recordId").alias("sha256"))
    return pairing.resolve(a, b, ["call_id"])
