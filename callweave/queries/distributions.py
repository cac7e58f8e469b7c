"""Counts, distributions and group statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import scalar
from callweave.operators import intervals, stats, text
from callweave.queries.intervals import SIDE_SQL, side
from callweave.queries.pairing import ONE_LABEL, _labels, one_call
from callweave.queries.registry import query, table

_MS = "(endAt - startAt)"
_USABLE = "startAt >= 0 AND endAt > startAt"


def _usable(spark, sf):
    return table(spark, sf, "utterances").where(intervals.usable()).withColumn("ms", F.col("endAt") - F.col("startAt"))


def _rounded(df, names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query("value_counts_top", "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 10")
def value_counts_top(spark, sf):
    return stats.value_counts(table(spark, sf, "documents"), "source", 10)


@query("value_counts_null", "SELECT speaker, count(*) AS n FROM utterances GROUP BY speaker")
def value_counts_null(spark, sf):
    return stats.value_counts(table(spark, sf, "utterances"), "speaker", dropna=False)


_CLASSES = "(SELECT unnest([" + ",".join(f"'{s}'" for s in scalar.SYMPTOMS) + "]) AS label)"


@query("symptom_counts", f"SELECT c.label AS label, coalesce(n, 0) AS n FROM {_CLASSES} c LEFT JOIN (SELECT unnest(symptom) AS label, count(*) n FROM call_labels GROUP BY 1) USING (label)")
def symptom_counts(spark, sf):
    classes = spark.createDataFrame([(s,) for s in scalar.SYMPTOMS], "label string")
    return stats.label_counts(table(spark, sf, "call_labels"), "symptom", classes)


@query("dense_counts", "SELECT s AS split, g AS gender, count(c.call_id) AS n FROM (SELECT unnest(['train','internal_validation','test']) s) a CROSS JOIN (SELECT unnest(['F','M','unknown']) g) b LEFT JOIN calls c ON c.partition = s AND c.gender = g GROUP BY 1, 2")
def dense_counts(spark, sf):
    c = table(spark, sf, "calls").withColumnRenamed("partition", "split")
    return stats.dense_counts(c, "split", ["train", "internal_validation", "test"], "gender", ["F", "M", "unknown"])


_EDGES = [0, 250, 500, 1000, 1500, 2000, 3000, 5000]
_BIN = "CASE " + " ".join(f"WHEN ms >= {a} AND ms < {b} THEN '[{a},{b})'" for a, b in zip(_EDGES, _EDGES[1:])) + " WHEN ms >= 5000 THEN '[5000,inf)' END"


@query("duration_bins", f"SELECT side, bin, n, round(n / sum(n) OVER (PARTITION BY side), 9) AS share FROM (SELECT side, {_BIN} AS bin, count(*) AS n FROM (SELECT {SIDE_SQL} AS side, {_MS} AS ms FROM utterances WHERE {_USABLE}) WHERE side <> 'unknown' GROUP BY 1, 2)")
def duration_bins(spark, sf):
    u = _usable(spark, sf).withColumn("side", side()).where("side <> 'unknown'")
    return _rounded(stats.binned_shares(u, ["side"], scalar.bin_label(F.col("ms"), _EDGES)), ["share"], 9)


@query("stats_by_group", f"SELECT speaker, count(ms) AS n, round(avg(ms), 6) AS mean, min(ms) AS min, max(ms) AS max, round(quantile_cont(ms, 0.25), 6) AS q25, round(median(ms), 6) AS median, round(quantile_cont(ms, 0.75), 6) AS q75, round(quantile_cont(ms, 0.9), 6) AS q90, round(quantile_cont(ms, 0.95), 6) AS q95 FROM (SELECT speaker, CAST({_MS} AS DOUBLE) AS ms FROM utterances WHERE {_USABLE}) GROUP BY speaker")
def stats_by_group(spark, sf):
    return _rounded(stats.stats(_usable(spark, sf), ["speaker"], "ms"), ["mean", "q25", "median", "q75", "q90", "q95"])


@query("stats_finite", "SELECT count(x) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median FROM (SELECT total_duration_s AS x FROM benchmark_calls WHERE NOT isnan(total_duration_s) AND NOT isinf(total_duration_s))")
def stats_finite(spark, sf):
    return _rounded(stats.stats(table(spark, sf, "benchmark_calls"), [], "total_duration_s"), ["mean", "median"]).select("n", "mean", "median")


@query("quantiles6", "SELECT l_returnflag, " + ", ".join(f"round_even({e}, 4) AS {n}" for e, n in (("min(x)", "min"), ("quantile_cont(x, 0.25)", "q25"), ("median(x)", "median"), ("quantile_cont(x, 0.75)", "q75"), ("quantile_cont(x, 0.95)", "q95"), ("max(x)", "max"), ("avg(x)", "mean"))) + " FROM (SELECT l_returnflag, l_extendedprice AS x FROM lineitem) GROUP BY l_returnflag")
def quantiles6(spark, sf):
    return stats.quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", 4)


@query("quantiles_of_any_size", f"SELECT speaker, p, round(CASE p WHEN 0.25 THEN quantile_cont(ms, 0.25) WHEN 0.5 THEN quantile_cont(ms, 0.5) ELSE quantile_cont(ms, 0.95) END, 6) AS quantile FROM (SELECT speaker, CAST({_MS} AS DOUBLE) AS ms FROM utterances WHERE {_USABLE}), (SELECT unnest([0.25::DOUBLE, 0.5, 0.95]) AS p) GROUP BY speaker, p")
def quantiles_of_any_size(spark, sf):
    """The same quantiles where a group may hold a third of all rows."""
    return _rounded(stats.exact_quantiles(_usable(spark, sf), ["speaker"], "ms", [0.25, 0.5, 0.95]), ["quantile"])


@query(
    "nested_report",
    f"""WITH u AS (SELECT coalesce(c.partition, 'none') AS split, l.call_id IS NOT NULL AS m, {SIDE_SQL} AS side, u.endAt - u.startAt AS ms FROM utterances u
  JOIN (SELECT DISTINCT ON (lower(trim(call_id))) lower(trim(call_id)) AS call_id, partition FROM calls ORDER BY lower(trim(call_id)), loaded_at) c USING (call_id)
  LEFT JOIN (SELECT DISTINCT call_id FROM call_labels) l USING (call_id) WHERE {_USABLE} AND {SIDE_SQL} <> 'unknown'),
s AS (SELECT split, 'all' AS scope, side, ms FROM u UNION ALL SELECT split, 'matched', side, ms FROM u WHERE m)
SELECT split, scope, side, CAST(grouping(side) AS INTEGER) AS all_groups, count(*) AS n, CAST(sum(ms) AS BIGINT) AS total, round(avg(ms), 6) AS mean, median(ms) AS median, min(ms) AS min, max(ms) AS max,
count(*) FILTER (ms < 500) AS below_500, count(*) FILTER (ms < 1000) AS below_1000 FROM s GROUP BY GROUPING SETS ((split, scope, side), (split, scope))""",
)
def nested_report(spark, sf):
    """Measures by partition, scope and side: one pass with grouping sets, not one query a cell."""
    c = one_call(spark, sf).select("call_id", F.coalesce("partition", F.lit("none")).alias("split"))
    lab = table(spark, sf, "call_labels").select("call_id").distinct().withColumn("_m", F.lit(True))
    u = _usable(spark, sf).withColumn("side", side()).where("side <> 'unknown'").join(c, "call_id").join(lab, "call_id", "left")
    return _rounded(stats.nested_report(u, "split", "side", F.col("_m").isNotNull(), "ms", [500, 1000]), ["mean"])


@query("short_counts", f"SELECT call_id, count(*) FILTER (ms < 500) AS below_500, count(*) FILTER (ms < 1000) AS below_1000, count(*) FILTER (ms < 2000) AS below_2000 FROM (SELECT call_id, {_MS} AS ms FROM utterances WHERE {_USABLE}) GROUP BY call_id")
def short_counts(spark, sf):
    return stats.short_counts(_usable(spark, sf), ["call_id"], "ms", [500, 1000, 2000])


@query("boolean_shares", f"SELECT speaker, round(avg(CAST({_MS} < 1000 AS INTEGER)), 9) AS short, round(avg(CAST(text LIKE '%[%' AS INTEGER)), 9) AS marked FROM utterances WHERE {_USABLE} AND text IS NOT NULL GROUP BY speaker")
def boolean_shares(spark, sf):
    u = _usable(spark, sf).where("text is not null")
    return _rounded(stats.shares(u, ["speaker"], short=F.col("ms") < 1000, marked=F.col("text").contains("[")), ["short", "marked"], 9)


@query("partition_distribution", "SELECT partition, count(*) AS n, count(*) FILTER (gender = 'F') AS n_f, round(count(*) FILTER (gender = 'F') / count(*), 9) AS share_f, round(sum(total_duration), 3) AS total_s, count(*) FILTER (total_duration < 60) AS n_short FROM calls GROUP BY partition")
def partition_distribution(spark, sf):
    c = table(spark, sf, "calls")
    f = F.col("gender") == "F"
    return c.groupBy("partition").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(f).alias("n_f"), F.round(F.count_if(f) / F.count(F.lit(1)), 9).alias("share_f"), F.round(F.sum("total_duration"), 3).alias("total_s"), F.count_if(F.col("total_duration") < 60).alias("n_short")
    )


@query("smd", "WITH t AS (SELECT avg(total_duration) FILTER (partition = 'train') a, avg(total_duration) FILTER (partition = 'internal_validation') b, var_samp(total_duration) FILTER (partition = 'train') va, var_samp(total_duration) FILTER (partition = 'internal_validation') vb FROM calls) SELECT round(CASE WHEN va + vb = 0 THEN 0 ELSE (b - a) / sqrt((va + vb) / 2) END, 9) AS smd FROM t")
def smd(spark, sf):
    return _rounded(stats.standardized_difference(table(spark, sf, "calls"), "partition", "train", "internal_validation", "total_duration"), ["smd"], 9)


@query("bin_gap", "WITH b AS (SELECT CASE WHEN total_duration < 30 THEN 0 WHEN total_duration < 60 THEN 1 WHEN total_duration < 120 THEN 2 ELSE 3 END AS bin, partition FROM calls WHERE total_duration >= 0), c AS (SELECT bin, count(*) FILTER (partition = 'train') na, count(*) FILTER (partition = 'internal_validation') nb FROM b GROUP BY bin) SELECT round(max(abs(na / ta - nb / tb)) * 100, 6) AS max_gap_pp FROM c, (SELECT sum(na) ta, sum(nb) tb FROM c)")
def bin_gap(spark, sf):
    return _rounded(stats.bin_gap(table(spark, sf, "calls"), "partition", "train", "internal_validation", scalar.bin_label(F.col("total_duration"), [0, 30, 60, 120])), ["max_gap_pp"])


@query("majority_baseline", "WITH c AS (SELECT gender, count(*) FILTER (partition = 'train') a, count(*) FILTER (partition = 'test') b FROM calls WHERE gender IN ('F', 'M') GROUP BY gender) SELECT arg_max(gender, (a, gender)) AS majority, round(arg_max(b, (a, gender)) / sum(b), 9) AS accuracy FROM c")
def majority_baseline(spark, sf):
    return _rounded(stats.majority_baseline(table(spark, sf, "calls").where("gender in ('F', 'M')"), "partition", "train", "test", "gender"), ["accuracy"], 9)


@query("id_duplicates", "WITH l AS (SELECT '_id' AS field, _id AS v, mediaType AS p FROM call_labels UNION ALL SELECT 'recordId', recordId, mediaType FROM call_labels UNION ALL SELECT 'call_id', call_id, mediaType FROM call_labels), g AS (SELECT field, v, count(*) n, min(p) a, max(p) b FROM l WHERE v IS NOT NULL GROUP BY 1, 2) SELECT field, count(*) AS n_values, count(*) FILTER (n > 1) AS n_repeated, CAST(sum(n - 1) AS BIGINT) AS n_excess, count(*) FILTER (a <> b) AS n_across FROM g GROUP BY field")
def id_duplicates(spark, sf):
    return stats.id_duplicates(table(spark, sf, "call_labels"), ["_id", "recordId", "call_id"], "mediaType")


@query("staged_duplicates", "WITH d AS (SELECT doc_id, length(text) n, text FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, sha256(text) AS digest FROM d) SELECT doc_id, digest FROM e WHERE digest IN (SELECT digest FROM e GROUP BY digest HAVING count(*) > 1)")
def staged_duplicates(spark, sf):
    """Exact copies of documents: length, then the hash of both ends, then of the whole of what is left."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text", F.length("text").alias("size"))
    return stats.staged_duplicates(d, "doc_id", "size", scalar.edge_hash(F.col("text"), 256), F.sha2("text", 256))


@query("text_duplicates", "SELECT kind, count(text) AS n_texts, count(text) - count(DISTINCT text) AS n_excess, count(*) FILTER (trim(coalesce(text, '')) = '') AS n_empty FROM documents GROUP BY kind")
def text_duplicates(spark, sf):
    return stats.text_duplicates(table(spark, sf, "documents"), "text", "kind")


_FLAGS = [f"s{i}" for i in range(len(scalar.SYMPTOMS))]
_HOT = ", ".join(f"CAST(coalesce(list_contains(symptom, '{s}'), false) AS INTEGER) AS {n}" for s, n in zip(scalar.SYMPTOMS, _FLAGS))


def hot(spark, sf):
    return text.multi_hot(_labels(spark, sf), "symptom", scalar.SYMPTOMS, ["call_id", "gender", "triage"], _FLAGS)


@query("multi_hot", f"SELECT call_id, gender, triage, {_HOT} FROM {ONE_LABEL}")
def multi_hot(spark, sf):
    return hot(spark, sf)


@query("label_cardinality", f"SELECT CAST({' + '.join(_FLAGS)} AS BIGINT) AS n_labels, count(*) AS n FROM (SELECT {_HOT} FROM {ONE_LABEL}) GROUP BY 1")
def label_cardinality(spark, sf):
    return stats.label_cardinality(hot(spark, sf), _FLAGS)


@query("label_rates", f"SELECT triage, {', '.join(f'round(avg({f}), 9) AS {f}' for f in _FLAGS)} FROM (SELECT triage, {_HOT} FROM {ONE_LABEL}) GROUP BY triage")
def label_rates(spark, sf):
    return _rounded(stats.label_rates(hot(spark, sf), "triage", _FLAGS), _FLAGS, 9)


@query("class_weights", "SELECT label, round(least(3, greatest(1, coalesce(sqrt(neg / nullif(pos, 0)), 3))), 9) AS weight FROM (SELECT label, sum(y) pos, count(*) - sum(y) neg FROM (UNPIVOT (SELECT " + _HOT + f" FROM {ONE_LABEL}) ON {', '.join(_FLAGS)} INTO NAME label VALUE y) GROUP BY label)")
def class_weights(spark, sf):
    return _rounded(stats.class_weights(hot(spark, sf), _FLAGS), ["weight"], 9)


@query("issue_counts", f"WITH i AS (SELECT coalesce(speaker, 'none') AS split, CASE WHEN startAt IS NULL OR endAt IS NULL THEN 'missing' WHEN startAt < 0 THEN 'negative' WHEN endAt <= startAt THEN 'reversed' END AS issue FROM utterances) SELECT split, issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT 'all', issue, count(*) FROM i WHERE issue IS NOT NULL GROUP BY issue")
def issue_counts(spark, sf):
    u = table(spark, sf, "utterances").withColumn("split", F.coalesce("speaker", F.lit("none")))
    i = text.rejection_reasons(u, missing=F.col("startAt").isNull() | F.col("endAt").isNull(), negative=F.col("startAt") < 0, reversed=F.col("endAt") <= F.col("startAt"))
    return stats.issue_counts(i.withColumnRenamed("reason", "issue").where("issue is not null"))


@query("item_features", "SELECT l_orderkey, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(median({c}), 6) AS {c}_median, round(stddev_pop({c}), 6) AS {c}_std" for c in ("l_quantity", "l_discount")) + " FROM lineitem GROUP BY l_orderkey")
def item_features(spark, sf):
    d = stats.item_features(table(spark, sf, "lineitem"), "l_orderkey", ["l_quantity", "l_discount"])
    return _rounded(d, d.columns[1:])


@query("mean_vector", "SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos")
def mean_vector(spark, sf):
    return _rounded(stats.mean_vector(table(spark, sf, "embeddings"), "label", "embedding"), ["mean"])


@query("weighted_mean", "SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS weighted_mean FROM lineitem GROUP BY l_suppkey")
def weighted_mean(spark, sf):
    return _rounded(stats.weighted_mean(table(spark, sf, "lineitem"), ["l_suppkey"], "l_discount", "l_quantity"), ["weighted_mean"], 9)


@query("header_summary", "SELECT sample_rate, channels, count(*) AS n, count(*) FILTER (riff_status <> 'ok') AS n_damaged, min(duration_s) AS min_s, max(duration_s) AS max_s, round(avg(duration_s), 6) AS mean_s FROM audio_headers GROUP BY 1, 2")
def header_summary(spark, sf):
    return _rounded(stats.header_summary(table(spark, sf, "audio_headers")), ["mean_s"])


@query("length_limits", "SELECT median(n) AS median, count(*) FILTER (n > 512) AS n_over, round(avg(CAST(n > 512 AS INTEGER)), 9) AS rate_over FROM (SELECT length(text) AS n FROM documents WHERE text IS NOT NULL)")
def length_limits(spark, sf):
    return _rounded(stats.length_limits(table(spark, sf, "documents").where("text is not null"), F.length("text"), 512), ["rate_over"], 9)


@query("describe_calls", "SELECT partition, round(avg(total_duration), 6) AS mean, round(median(total_duration), 6) AS median, min(total_duration) AS min, max(total_duration) AS max FROM calls GROUP BY partition")
def describe_calls(spark, sf):
    return _rounded(stats.describe(table(spark, sf, "calls"), ["partition"], "total_duration"), ["mean", "median"])
