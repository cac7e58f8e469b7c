"""Checks between tables, and the remaining scalar and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import scalar, udfs
from callweave.operators import checks, pairing, signals, stats, text
from callweave.queries.pairing import ONE_LABEL, _labels
from callweave.queries.intervals import SIDE_SQL, side
from callweave.queries.registry import query, table
from callweave.queries.texts import SCHEMA_SQL


@query(
    "consistent_features",
    "WITH b AS (SELECT call_id, min(gender) AS g, min(n_segments) AS n FROM benchmark_calls GROUP BY 1), m AS (SELECT call_id, gender AS g, num_segments AS n FROM mission1_manifest) SELECT call_id, CASE WHEN b.g IS DISTINCT FROM m.g THEN 'gender' WHEN b.n IS DISTINCT FROM m.n THEN 'n_segments' END AS mismatch FROM b JOIN m USING (call_id)",
)
def consistent_features(spark, sf):
    """Calls of two tables with the first column on which these disagree."""
    b = table(spark, sf, "benchmark_calls").groupBy("call_id").agg(F.min("gender").alias("gender"), F.min("n_segments").alias("n_segments"))
    m = table(spark, sf, "mission1_manifest").select("call_id", "gender", F.col("num_segments").alias("n_segments"))
    return pairing.consistent_features([b, m], "call_id", ["gender", "n_segments"]).select("call_id", "mismatch")


@query("misaligned", f"SELECT coalesce(m.call_id, l.call_id) AS call_id FROM (SELECT call_id, gender FROM mission1_manifest) m FULL JOIN {ONE_LABEL} l ON m.call_id = l.call_id WHERE m.call_id IS NULL OR l.call_id IS NULL OR m.gender IS DISTINCT FROM l.gender")
def misaligned(spark, sf):
    return checks.misaligned(table(spark, sf, "mission1_manifest"), _labels(spark, sf), "call_id", ["gender"])


@query("vector_faults", "SELECT vec_id FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64 OR embedding[1] < 0 OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 OR embedding[1] > 0.2")
def vector_faults(spark, sf):
    """Vectors that can't be used; to have some, those of a large first value lose it and those of a negative one get the
    logarithm of it in its place, which is no number."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    first = F.log1p(F.when(F.col("x")[0] < 0, F.col("x")[0] - 10).otherwise(F.col("x")[0]))
    x = F.when(F.col("x")[0] > 0.2, F.slice("x", 2, 64)).otherwise(F.concat(F.array(F.when(F.col("x")[0] < 0, F.coalesce(first, F.lit(float("nan")))).otherwise(first)), F.slice("x", 2, 64)))
    return checks.vector_faults(e.withColumn("x", x), "x", 64).select("vec_id")


@query("metric_gaps", "WITH a AS (SELECT gender AS metric, count(*)::DOUBLE AS value FROM calls WHERE gender IS NOT NULL GROUP BY 1), b AS (SELECT gender AS metric, count(*)::DOUBLE AS published FROM mission1_manifest WHERE gender IS NOT NULL GROUP BY 1) SELECT metric, value, published FROM a FULL JOIN b USING (metric) WHERE coalesce(abs(value - published) > 1e-15, true)")
def metric_gaps(spark, sf):
    """Recomputed figures against stored ones."""
    count = lambda t: table(spark, sf, t).where("gender is not null").groupBy(F.col("gender").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return checks.metric_gaps(count("calls"), count("mission1_manifest"))


@query("pooled_vector", "SELECT vec_id, CAST(i AS INTEGER) AS pos, round(list_avg(list_transform(embedding[CAST(round_even(i * 64 / 24.0::DOUBLE, 0) AS INTEGER) + 1:CAST(round_even((i + 1) * 64 / 24.0::DOUBLE, 0) AS INTEGER)], lambda x: x::DOUBLE)), 6) AS mean FROM embeddings, range(24) r(i)")
def pooled_vector(spark, sf):
    """Vectors pooled to 24 bins at rounded, evenly spaced boundaries."""
    p = signals.pooled(F.col("embedding").cast("array<double>"), 24)
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(p).alias("pos", "mean")).select("vec_id", "pos", F.round("mean", 6).alias("mean"))


@query("vector_levels", "SELECT vec_id, round(10 * log10(greatest(abs(embedding[1]::DOUBLE), 1e-10)), 6) AS db, CAST(round_even(least(1, greatest(0, embedding[1]::DOUBLE)) * 255, 0) AS INTEGER) AS level, embedding[64] AS last FROM embeddings")
def vector_levels(spark, sf):
    x = F.col("embedding")[0].cast("double")
    unit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return table(spark, sf, "embeddings").select("vec_id", F.round(scalar.decibel(F.abs(x)), 6).alias("db"), scalar.quantise(unit).alias("level"), F.reverse("embedding")[0].alias("last"))


@query("joined_tokens", "SELECT call_id, array_to_string(symptom, ' | ') AS tokens FROM call_labels WHERE len(symptom) > 0")
def joined_tokens(spark, sf):
    """Token lists joined with a separator between, not after, the parts."""
    parts = F.transform("symptom", lambda s: F.array(s))
    lab = table(spark, sf, "call_labels").where(F.size("symptom") > 0)
    return lab.select("call_id", F.array_join(scalar.join_token_lists(parts, F.lit("|")), " ").alias("tokens"))


@query("guarded_values", "SELECT CASE WHEN gender IN ('M', 'F') THEN gender ELSE 'unknown' END AS gender, contains(lower(coalesce(wav_path, '')), 'training') AS training, count(*) AS n FROM calls GROUP BY 1, 2")
def guarded_values(spark, sf):
    """Unexpected values become ``unknown``; folders are told apart whatever their case."""
    c = table(spark, sf, "calls")
    return c.groupBy(scalar.one_of(F.col("gender"), ["M", "F"]).alias("gender"), scalar.contains_any(F.col("wav_path"), ["Training"], fold=True).alias("training")).agg(F.count(F.lit(1)).alias("n"))


@query("id_list_hash", "SELECT gender, sha256(string_agg(call_id, chr(10) ORDER BY call_id)) AS h FROM mission1_manifest GROUP BY gender")
def id_list_hash(spark, sf):
    """The hash of an ordered id list, as an identity to compare on resume."""
    return table(spark, sf, "mission1_manifest").groupBy("gender").agg(scalar.list_hash(F.collect_list("call_id")).alias("h"))


@query("column_whitelist", "SELECT call_id, id, startAt, endAt, speaker FROM utterances WHERE " + SIDE_SQL + " <> 'unknown'")
def column_whitelist(spark, sf):
    """Utterances for an acoustic task: the text can't leak, as it is not among the columns."""
    return text.only_columns(table(spark, sf, "utterances").where(side() != "unknown"), ["call_id", "id", "startAt", "endAt", "speaker"])


@query("sample_counts", "SELECT call_id, CAST(2 * sum(round_even(e / 1000.0::DOUBLE * 8000, 0) - round_even(s / 1000.0::DOUBLE * 8000, 0)) AS BIGINT) AS n FROM (SELECT DISTINCT call_id, id, startAt s, endAt e FROM utterances WHERE startAt >= 0 AND endAt > startAt AND " + SIDE_SQL + " = 'reporter') GROUP BY call_id")
def sample_counts(spark, sf):
    """Samples that the reporter's segments give after resampling from 8 to 16 kHz."""
    u = table(spark, sf, "utterances").where("startAt >= 0 and endAt > startAt").where(side() == "reporter").select("call_id", "id", "startAt", "endAt").distinct()
    one = F.array(F.struct((F.col("startAt") / 1000).alias("s"), (F.col("endAt") / 1000).alias("e")))
    return u.groupBy("call_id").agg(F.sum(scalar.resampled_samples(one)).alias("n"))


@query("duplicate_texts_across", "SELECT DISTINCT a.text AS text FROM (SELECT text FROM utterances WHERE " + SIDE_SQL + " = 'dispatcher') a JOIN (SELECT text FROM utterances WHERE " + SIDE_SQL + " = 'reporter') b USING (text)")
def duplicate_texts_across(spark, sf):
    """Texts that both sides have said."""
    u = table(spark, sf, "utterances")
    return pairing.shared_values(u.where(side() == "dispatcher"), u.where(side() == "reporter"), "text").where("text is not null")


@query("two_views")
def two_views(spark, sf):
    """Two-view features of vectors taken as waveforms: 64 x 48 bytes each."""
    return table(spark, sf, "embeddings").select("vec_id", F.length(udfs.two_view_features("embedding")).alias("n_bytes"), F.sha2(udfs.two_view_features("embedding"), 256).alias("h"))


@query("resampled_vectors")
def resampled_vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(udfs.resampled("embedding")).alias("pos", "value"))


_FIELDS = {**dict.fromkeys(("call_id", "_id", "recordId", "audioPath", "mediaType", "gender", "address", "disasterLarge", "disasterMedium", "urgencyLevel", "sentiment", "triage"), "string"), "status": "integer", "startAt": "integer", "endAt": "number"}
_WALKED = " UNION ALL ".join(
    [f"SELECT '{f}' AS path, '{t}' AS type, CAST({f} AS VARCHAR) AS value FROM call_labels WHERE {f} IS NOT NULL" for f, t in _FIELDS.items()]
    + ["SELECT '$', 'object', NULL FROM call_labels", "SELECT 'symptom', 'array', NULL FROM call_labels WHERE symptom IS NOT NULL"]
    + ["SELECT 'symptom[]', CASE WHEN s IS NULL THEN 'null' ELSE 'string' END, s FROM (SELECT unnest(symptom) AS s FROM call_labels)"]
)


@query("label_paths", f"WITH walked AS ({_WALKED})" + SCHEMA_SQL)
def label_paths(spark, sf):
    """The schema that label rows show when walked as JSON documents: paths, types, examples."""
    lab = table(spark, sf, "call_labels")
    return stats.schema_stats(udfs.walked(lab.select("call_id", F.to_json(F.struct(*lab.columns)).alias("doc")), "call_id", "doc", inner=True))
