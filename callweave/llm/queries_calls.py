"""Queries of problems 1, 2 and 5, over the call tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.llm import sampling, splits, splitting
from callweave.llm.registry import query, table
from callweave.session import durable

P1_SQL = """
WITH RECURSIVE b AS (SELECT DISTINCT call_id, model_chunks FROM benchmark_calls WHERE model_chunks IS NOT NULL),
j AS (SELECT DISTINCT m.call_id, unnest(CAST(reporter_segments_ms AS BIGINT[][])) p FROM mission1_manifest m JOIN (SELECT DISTINCT call_id FROM b) USING (call_id)),
s AS (SELECT call_id, p[2] - p[1] AS len, row_number() OVER (PARTITION BY call_id ORDER BY p[1], p[2]) rn FROM (SELECT DISTINCT call_id, p FROM j WHERE p[2] > p[1])),
g AS (
  SELECT call_id, CAST(0 AS BIGINT) rn, CAST(0 AS BIGINT) n, CAST(99999999 AS BIGINT) fill FROM b GROUP BY call_id
  UNION ALL
  SELECT g.call_id, s.rn,
    CASE WHEN s.len > 15000 THEN g.n + 1 + CAST(ceil((s.len - 15000) / 14000.0) AS BIGINT) WHEN g.fill + s.len > 15000 THEN g.n + 1 ELSE g.n END,
    CASE WHEN s.len > 15000 THEN 99999999 WHEN g.fill + s.len > 15000 THEN s.len ELSE g.fill + s.len END
  FROM g JOIN s ON s.call_id = g.call_id AND s.rn = g.rn + 1),
c AS (SELECT call_id, max(n) n FROM g GROUP BY call_id)
SELECT DISTINCT b.call_id AS call_id FROM b JOIN c USING (call_id) WHERE b.model_chunks <> c.n"""


@query("p1_found", P1_SQL)
def p1_found(spark, sf):
    b = table(spark, sf, "benchmark_calls").where("model_chunks is not null").select("call_id", "model_chunks").distinct()
    m = table(spark, sf, "mission1_manifest").join(b.select("call_id"), "call_id", "left_semi").select("call_id", "reporter_segments_ms").distinct()
    m = splitting.merged(m, "call_id", splitting.segments_from_json("reporter_segments_ms"))
    n = splitting.piece_counts(m, "call_id", F.col("segments"))
    return b.join(n, "call_id").where("model_chunks <> n_pieces").select("call_id").distinct()


@query("p1_pieces")
def p1_pieces(spark, sf):
    """Every piece of every benchmark call."""
    b = table(spark, sf, "benchmark_calls").select("call_id").distinct()
    m = table(spark, sf, "mission1_manifest").join(b, "call_id", "left_semi").select("call_id", "reporter_segments_ms").distinct()
    m = splitting.merged(m, "call_id", splitting.segments_from_json("reporter_segments_ms"))
    return splitting.pieces(m, "call_id", F.col("segments"))


P1_COUNTS_SQL = (
    P1_SQL[: P1_SQL.rindex("SELECT DISTINCT b.call_id")].replace(" WHERE model_chunks IS NOT NULL", "")
    + """, t AS (SELECT call_id, CAST(sum(len + CASE WHEN len > 15000 THEN 1000 * CAST(ceil((len - 15000) / 14000.0) AS BIGINT) ELSE 0 END) AS BIGINT) AS total_ms FROM s GROUP BY call_id)
SELECT DISTINCT c.call_id AS call_id, c.n AS n_pieces, t.total_ms AS total_ms, true AS within FROM c JOIN t USING (call_id)"""
)


@query("p1_piece_counts", P1_COUNTS_SQL)
def p1_piece_counts(spark, sf):
    """What must hold of ``p1_pieces``: as few pieces as can be, nothing lost but what overlaps adds, all within the limit."""
    g = p1_pieces(spark, sf).groupBy("call_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("length").alias("total_ms"), (F.max("length") <= 15_000).alias("within"))
    return g.select("call_id", "n_pieces", "total_ms", "within")


P2_SQL = r"""
WITH RECURSIVE c AS (
  SELECT lower(regexp_replace(call_id, '\s+', '', 'g')) AS call_id,
    split_part(lower(trim(regexp_extract(wav_relative_path, '([^/\\]*)$', 1))), '_', 1) AS prefix,
    CASE WHEN regexp_matches(regexp_replace(lower(caller_ref), '[^0-9a-z가-힣]+', '', 'g'), '^c[0-9a-f]{8}$') THEN regexp_replace(lower(caller_ref), '[^0-9a-z가-힣]+', '', 'g') END AS ref,
    nullif(regexp_replace(lower(trim(partition)), '[\s\-]+', '_', 'g'), '') AS part
  FROM calls WHERE call_id IS NOT NULL),
e AS (SELECT DISTINCT call_id, 'p' || prefix AS k FROM c WHERE prefix <> '' UNION SELECT DISTINCT call_id, 'c' || ref FROM c WHERE ref IS NOT NULL),
l AS (SELECT DISTINCT a.call_id AS a, b.call_id AS b FROM e a JOIN e b USING (k)),
r AS (SELECT DISTINCT call_id AS a, call_id AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
g AS (SELECT a AS call_id, min(b) AS group_id FROM r GROUP BY a),
t AS (SELECT group_id FROM g JOIN c USING (call_id) WHERE part IS NOT NULL GROUP BY group_id HAVING count(DISTINCT part) > 1)
SELECT call_id, group_id FROM g WHERE group_id IN (SELECT group_id FROM t)"""


SHARES = {"train": 0.8, "internal_validation": 0.1, "test": 0.1}


def component_table(spark, sf):
    """The persisted table of components and splits after all calls have been loaded, in three batches by time of
    arrival."""
    calls = table(spark, sf, "calls").select("call_id", "gender", "wav_relative_path", "caller_ref", "loaded_at")
    q = calls.agg(F.percentile_approx(F.col("loaded_at").cast("timestamp").cast("double"), F.array(F.lit(0.6), F.lit(0.85)), 1000).alias("q")).first()[0] or [0, 0]
    at = F.coalesce(F.col("loaded_at").cast("timestamp").cast("double"), F.lit(float("inf")))
    state = keys = None
    for low, high in ((float("-inf"), q[0]), (q[0], q[1]), (q[1], float("inf"))):
        batch = calls.where((at > low) & (at <= high))
        edges = splits.call_edges(batch)
        strata = batch.groupBy(splits.plain_id("call_id").alias("record")).agg(F.mode(splits.plain_gender("gender"), True).alias("stratum")).where("record is not null")
        state, keys = splits.assign_splits(state, keys, edges, strata, SHARES)
    return state


@query("p2_found", P2_SQL)
def p2_found(spark, sf):
    """Groups as the batches leave them in the component table; a group goes by its least record, whichever came first."""
    calls = table(spark, sf, "calls").select("call_id", "partition")
    parts = calls.select(splits.plain_id("call_id").alias("record"), splits.plain_partition("partition").alias("partition"))
    found = splits.divided(component_table(spark, sf).select("record", "component"), parts)
    names = found.groupBy("component").agg(F.min("record").alias("group_id"))
    return found.join(names, "component").select(F.col("record").alias("call_id"), "group_id").distinct()


@query("p2_splits")
def p2_splits(spark, sf):
    """Splits of all calls, loaded in three batches by time of arrival."""
    return component_table(spark, sf)


P2_SUMMARY_SQL = P2_SQL[: P2_SQL.index("\nt AS")].rstrip(",") + """
SELECT count(*) AS n_records, count(DISTINCT group_id) AS n_components, CAST(0 AS BIGINT) AS n_divided, CAST(0 AS BIGINT) AS n_without FROM g"""


@query("p2_split_summary", P2_SUMMARY_SQL)
def p2_split_summary(spark, sf):
    """What must hold of ``p2_splits``: all records and components are there, no component outside quarantine has more
    than one split, none of its records is without."""
    d = component_table(spark, sf)
    each = d.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("splits"), F.count_if(F.col("split").isNull()).alias("none"), F.max(F.col("status") == "quarantined").alias("q"))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"),
        F.count(F.lit(1)).alias("n_components"),
        F.count_if(~F.col("q") & (F.col("splits") != 1)).alias("n_divided"),
        F.count_if(~F.col("q") & (F.col("none") > 0)).alias("n_without"),
    )


@query("p5_sample")
def p5_sample(spark, sf):
    """A tenth of the calls of each partition; the calls arrive in two batches, the second of which adds to the first."""
    calls = table(spark, sf, "calls").select(
        splits.plain_id("call_id").alias("call_id"), F.coalesce(splits.plain_partition("partition"), F.lit("none")).alias("partition"), "loaded_at"
    )
    mid = calls.agg(F.percentile_approx(F.col("loaded_at").cast("timestamp").cast("double"), 0.7, 1000)).first()[0] or 0.0
    late = F.coalesce(F.col("loaded_at").cast("timestamp").cast("double") > mid, F.lit(True))
    store = durable(sampling.first_sight(None, calls.where(~late), "call_id", "partition", "loaded_at"), "prn")
    limits = sampling.raise_thresholds(None, store, 0.1)
    more = sampling.first_sight(store, calls.where(late), "call_id", "partition", "loaded_at")
    store = durable(store.unionByName(more), "prn")
    limits = sampling.raise_thresholds(limits, store, 0.1)
    return sampling.select(store, limits).select(F.col("id").alias("call_id"), F.col("stratum").alias("partition"), F.round("u", 12).alias("u"))
