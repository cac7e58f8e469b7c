"""Queries of the scalar, JSON, audio and model operators that no other module registers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.functions import audio, scalar, udfs
from callweave.operators import checks, ml, pairing, sampling
from callweave.queries.distributions import _FLAGS, _HOT, hot
from callweave.queries.pairing import ONE_LABEL, _labels
from callweave.queries.registry import query, table


@query("word_flags", "SELECT doc_id, contains(text, '환자') OR contains(text, 'ambulance') AS hit FROM documents WHERE text IS NOT NULL")
def word_flags(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", scalar.contains_any(F.col("text"), ["환자", "ambulance"]).alias("hit"))


_SEG = "(SELECT call_id, CAST(reporter_segments_ms AS BIGINT[][]) AS s FROM mission1_manifest WHERE reporter_segments_ms IS NOT NULL)"


def _segments(spark, sf):
    m = table(spark, sf, "mission1_manifest").where("reporter_segments_ms is not null")
    return m.select("call_id", F.from_json("reporter_segments_ms", "array<array<bigint>>").alias("s"))


@query("overlap_lengths", f"SELECT call_id, CAST(i AS INTEGER) AS pos, greatest(0, least(s[i][2], s[i + 1][2]) - greatest(s[i][1], s[i + 1][1])) AS ms FROM {_SEG}, LATERAL (SELECT unnest(range(1, len(s))) AS i)")
def overlap_lengths(spark, sf):
    """How long each segment of a call overlaps the next in its list."""
    pairs = F.transform(F.slice(F.col("s"), F.lit(1), F.greatest(F.lit(0), F.size("s") - 1)), lambda a, i: scalar.overlap_length(a[0], a[1], F.get(F.col("s"), i + 1)[0], F.get(F.col("s"), i + 1)[1]))
    return _segments(spark, sf).select("call_id", F.posexplode(pairs).alias("p", "ms")).select("call_id", (F.col("p") + 1).alias("pos"), "ms")


@query("json_fields", f"SELECT call_id, CAST(len(s) AS INTEGER) AS n, coalesce(s[1][1], -1) AS first_ms, '[' || array_to_string(list_transform(s, lambda p: '[' || p[1] || ',' || p[2] || ']'), ',') || ']' AS text FROM {_SEG}")
def json_fields(spark, sf):
    """A nested field with a default, and the same JSON written again."""
    d = _segments(spark, sf)
    return d.select("call_id", F.size("s").alias("n"), F.coalesce(F.get(F.get("s", F.lit(0)), F.lit(0)), F.lit(-1)).alias("first_ms"), F.to_json("s").alias("text"))


@query("joined_paths", "SELECT DISTINCT '/data/' || regexp_replace(wav_relative_path, '^(\\./|/)+', '') AS path FROM calls WHERE wav_relative_path IS NOT NULL")
def joined_paths(spark, sf):
    c = table(spark, sf, "calls").where("wav_relative_path is not null")
    return c.select(scalar.join_path(F.lit("/data/"), F.col("wav_relative_path")).alias("path")).distinct()


@query("sorted_lists", f"SELECT call_id, array_to_string(list_sort(symptom), '|') AS symptoms FROM {ONE_LABEL} WHERE symptom IS NOT NULL")
def sorted_lists(spark, sf):
    return _labels(spark, sf).where("symptom is not null").select("call_id", F.array_join(F.sort_array("symptom"), "|").alias("symptoms"))


def _documents(spark, sf):
    """Labels as JSON documents in which the address lies a level down under another name."""
    lab = _labels(spark, sf)
    return lab.select("call_id", F.to_json(F.struct("gender", "triage", F.struct(F.col("address").alias("addr"), F.struct("symptom").alias("more")).alias("place"), F.expr("transform(symptom, s -> named_struct('name', s))").alias("found"))).alias("doc"))


@query("redacted_documents", f"SELECT call_id, gender, CASE WHEN triage IS NOT NULL THEN '<str:redacted>' END AS triage, CASE WHEN address IS NOT NULL THEN '<str:redacted>' END AS address, least(3, len(symptom)) AS n_shown FROM {ONE_LABEL}")
def redacted_documents(spark, sf):
    """Documents with all values masked but those of listed keys."""
    d = _documents(spark, sf).select("call_id", udfs.json_udf(udfs.redact, frozenset({"gender"}))("doc").alias("r"))
    g = lambda p: F.get_json_object("r", p)
    shown = F.size(F.from_json(g("$.found"), "array<map<string,string>>")).cast("bigint")
    return d.select("call_id", g("$.gender").alias("gender"), g("$.triage").alias("triage"), g("$.place.addr").alias("address"), F.when(g("$.found").isNotNull(), shown).alias("n_shown"))


@query("found_addresses", f"SELECT call_id, address FROM {ONE_LABEL} WHERE address IS NOT NULL")
def found_addresses(spark, sf):
    """The address of a document whose keys are not where they are looked for first."""
    return _documents(spark, sf).select("call_id", udfs.resolved_address(F.col("doc")).alias("address")).where("address is not null")


@query("found_strings", f"SELECT call_id, address AS hit FROM {ONE_LABEL} WHERE address LIKE '%서울특별시%'")
def found_strings(spark, sf):
    """The first string of a document that names the city."""
    return _documents(spark, sf).select("call_id", udfs.json_udf(udfs.find_string, "서울특별시")("doc").alias("hit")).where("hit is not null")


@query("found_records", f"SELECT call_id, array_to_string(symptom, ';') AS names FROM {ONE_LABEL} WHERE len(symptom) > 0")
def found_records(spark, sf):
    """The list of records in a document, wherever it lies."""
    r = _documents(spark, sf).select("call_id", udfs.json_udf(udfs.find_records, "name")("doc").alias("r")).where("r is not null")
    return r.select("call_id", F.array_join(F.transform(F.from_json("r", "array<struct<name:string>>"), lambda x: x["name"]), ";").alias("names"))


@query("equal_sets", "SELECT (SELECT count(*) FROM (SELECT file_ref FROM audio_headers EXCEPT SELECT call_id FROM mission1_manifest)) + (SELECT count(*) FROM (SELECT call_id FROM mission1_manifest EXCEPT SELECT file_ref FROM audio_headers)) = 0 AS same, true AS itself")
def equal_sets(spark, sf):
    h, m = table(spark, sf, "audio_headers").select(F.col("file_ref").alias("call_id")), table(spark, sf, "mission1_manifest").select("call_id")
    return spark.createDataFrame([(pairing.same_sets(h, m, "call_id"), pairing.same_sets(m, m.union(m), "call_id"))], "same boolean, itself boolean")


@query("all_issues", "SELECT call_id, 'label_missing' AS issue FROM (SELECT call_id FROM mission1_manifest EXCEPT SELECT call_id FROM call_labels) UNION ALL SELECT call_id, 'header_missing' FROM (SELECT call_id FROM mission1_manifest EXCEPT SELECT file_ref FROM audio_headers) UNION ALL SELECT DISTINCT file_ref, riff_status FROM audio_headers WHERE riff_status <> 'ok'")
def all_issues(spark, sf):
    """Issues of several checks in one table."""
    m, h = table(spark, sf, "mission1_manifest").select("call_id").distinct(), table(spark, sf, "audio_headers")
    out = pairing.missing_keys(m, table(spark, sf, "call_labels").select("call_id").distinct(), "call_id", "label_missing").select("call_id", "issue")
    out = out.unionByName(pairing.missing_keys(m, h.select(F.col("file_ref").alias("call_id")).distinct(), "call_id", "header_missing").select("call_id", "issue"))
    return out.unionByName(h.where("riff_status <> 'ok'").select(F.col("file_ref").alias("call_id"), F.col("riff_status").alias("issue")).distinct())


@query("state_identity", "SELECT true AS same, false AS other_settings, false AS other_schema")
def state_identity(spark, sf):
    """A state is known by its schema and settings."""
    a, b = table(spark, sf, "mission1_manifest"), table(spark, sf, "mission1_manifest").drop("gender")
    i = checks.identity(a, {"rate": "8000"})
    return spark.createDataFrame([(i == checks.identity(a.limit(1), {"rate": "8000"}), i == checks.identity(a, {"rate": "16000"}), i == checks.identity(b, {"rate": "8000"}))], "same boolean, other_settings boolean, other_schema boolean")


@query("train_statistics", "WITH t AS (SELECT o_totalprice AS x FROM orders WHERE o_orderstatus = 'F') SELECT round(median(x), 6) AS median, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM t")
def train_statistics(spark, sf):
    s = ml.train_statistics(table(spark, sf, "orders"), ["o_totalprice"], F.col("o_orderstatus") == "F")
    return s.select(*[F.round(f"o_totalprice_{n}", 6).alias(n) for n in ("median", "mean", "std")])


@query("cost_projection", "SELECT count(*) AS n, round(0.64 * (count(*) / 5000.0::DOUBLE) ** 2, 9) AS quadratic_s, round(83.46 / 655.8 * sum(duration_s) / 3600, 9) AS hours FROM audio_headers WHERE duration_s IS NOT NULL")
def cost_projection(spark, sf):
    """What a method of quadratic cost, and an encoder of measured rate, will take on all headers."""
    r = table(spark, sf, "audio_headers").where("duration_s is not null").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_s").alias("s")).first()
    hours, _ = ml.realtime_projection(83.46, 655.8, r["s"] or 0.0)
    return spark.createDataFrame([(r["n"], round(ml.quadratic_projection(0.64, 5000, r["n"]), 9), round(hours, 9))], "n bigint, quadratic_s double, hours double")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _masked(s: pd.Series) -> pd.Series:
    import numpy as np

    return pd.Series([None if x is None else audio.masked_mean(np.asarray(x, dtype=float).reshape(-1, 8), np.arange(len(x) // 8) < 5).tolist() for x in s], dtype=object)


@query("masked_means", "SELECT vec_id, CAST(j - 1 AS INTEGER) AS pos, round((embedding[j]::DOUBLE + embedding[j + 8]::DOUBLE + embedding[j + 16]::DOUBLE + embedding[j + 24]::DOUBLE + embedding[j + 32]::DOUBLE) / 5, 7) AS mean FROM embeddings, (SELECT unnest(range(1, 9)) AS j)")
def masked_means(spark, sf):
    """Vectors taken as eight frames of eight values, of which the first five count."""
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(_masked("embedding")).alias("pos", "mean")).select("vec_id", "pos", F.round("mean", 7).alias("mean"))


_I0 = "list_sum(list_transform(range(0, 40), lambda m: pow(({}) / 2, 2 * m) / pow(gamma(m + 1), 2)))"


@query(
    "resampled_points",
    f"WITH w AS (SELECT k, CASE WHEN k = 0 THEN 1 ELSE sin(pi() * k / 2) / (pi() * k / 2) END * {_I0.format('5 * sqrt(1 - pow(k / 20.0::DOUBLE, 2))')} AS h FROM (SELECT unnest(range(-20, 21)) AS k)), "
    "g AS (SELECT list(2 * h / z ORDER BY k) AS h FROM w, (SELECT sum(h) AS z FROM w)) SELECT vec_id, CAST(2 * len(embedding) AS INTEGER) AS n, round(embedding[33]::DOUBLE * h[21], 6) AS even, "
    "round(list_sum(list_transform(range(-19, 20, 2), lambda k: h[k + 21] * embedding[(65 - k) // 2 + 1]::DOUBLE)), 6) AS odd FROM embeddings, g",
)
def resampled_points(spark, sf):
    """Twice as many samples: one at a given place and the one after it, from twenty neighbours."""
    y = table(spark, sf, "embeddings").select("vec_id", udfs.resampled("embedding").alias("y"))
    return y.select("vec_id", F.size("y").alias("n"), F.round(F.col("y")[64], 6).alias("even"), F.round(F.col("y")[65], 6).alias("odd"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _bands(s: pd.Series) -> pd.Series:
    return pd.Series([audio.band_shares(x).tolist() for x in s], dtype=object)


@query("band_shares", "SELECT vec_id, CAST(5 AS INTEGER) AS n, CAST(1.0 AS DOUBLE) AS total FROM embeddings")
def band_shares(spark, sf):
    b = table(spark, sf, "embeddings").select("vec_id", _bands("embedding").alias("b"))
    return b.select("vec_id", F.size("b").alias("n"), F.round(F.aggregate("b", F.lit(0.0), lambda a, x: a + x), 9).alias("total"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _mel_summary(s: pd.Series) -> pd.Series:
    return pd.Series([audio.mfcc_db(x, 8000, 13, 40, 512, 160).mean(axis=1).tolist() for x in s], dtype=object)


@query("mfcc_defaults")
def mfcc_defaults(spark, sf):
    """The mean of 13 coefficients of a decibel Mel spectrum."""
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(_mel_summary("embedding")).alias("pos", "mean"))


@query(
    "multilabel_split",
    f"SELECT label, true AS balanced FROM (UNPIVOT (SELECT {_HOT} FROM {ONE_LABEL}) ON {', '.join(_FLAGS)} INTO NAME label VALUE y) GROUP BY label",
)
def multilabel_split(spark, sf):
    """Whether every label's share of held-out records is within two records, and a hundredth, of a fifth."""
    d = sampling.multilabel_split(hot(spark, sf), _FLAGS, "call_id", 0.2)
    long = d.select("held_out", F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in _FLAGS]), F.array(*[F.col(f).cast("int") for f in _FLAGS]))).alias("label", "y"))
    g = long.groupBy("label").agg(F.sum("y").alias("n"), F.sum(F.when(F.col("held_out"), F.col("y")).otherwise(0)).alias("h"))
    return g.select("label", (F.abs(F.col("h") - 0.2 * F.col("n")) <= 4 + 0.05 * F.col("n")).alias("balanced"))
