"""Projections, predicates, text and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import scalar, udfs
from callweave.operators import intervals, signals, text
from callweave.operators.sampling import balanced_parts
from callweave.queries.pairing import ONE_LABEL, _labels
from callweave.queries.intervals import SIDE_SQL, side
from callweave.queries.registry import query, table

_U = "(SELECT DISTINCT ON (id) call_id, id, startAt, endAt, text, speaker FROM utterances ORDER BY id, loaded_at)"


def once(spark, sf):
    """Every utterance once, as loaded first."""
    u = table(spark, sf, "utterances")
    return u.groupBy("id").agg(F.min_by(F.struct("call_id", "startAt", "endAt", "text", "speaker"), "loaded_at").alias("r")).select("id", "r.*")


@query(
    "flat_record",
    f"SELECT call_id, l.gender AS gender, l.address LIKE '%서울%' AS is_region, round((l.endAt - 0) / 1000.0, 6) AS duration_sec, array_to_string(l.symptom, ';') AS symptoms, u.n AS num_utterances, u.n0 AS num_speaker_0, u.n1 AS num_speaker_1 FROM {ONE_LABEL} l LEFT JOIN (SELECT call_id, count(*) n, count(*) FILTER ({SIDE_SQL} = 'dispatcher') n0, count(*) FILTER ({SIDE_SQL} = 'reporter') n1 FROM {_U} GROUP BY 1) u USING (call_id)",
)
def flat_record(spark, sf):
    s = side()
    u = once(spark, sf).groupBy("call_id").agg(F.count(F.lit(1)).alias("num_utterances"), F.count_if(s == "dispatcher").alias("num_speaker_0"), F.count_if(s == "reporter").alias("num_speaker_1"))
    lab = _labels(spark, sf).select("call_id", "gender", F.col("address").contains("서울").alias("is_region"), F.round(F.col("endAt") / 1000, 6).alias("duration_sec"), F.array_join("symptom", ";").alias("symptoms"))
    return lab.join(u, "call_id", "left")


@query("call_text", f"SELECT call_id, sha256(string_agg(coalesce(text, ''), ' ' ORDER BY startAt, id)) AS text_hash, count(*) AS n FROM {_U} WHERE startAt >= 0 AND endAt > startAt GROUP BY call_id")
def call_text(spark, sf):
    u = once(spark, sf).where(intervals.usable())
    n = u.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"))
    return text.call_text(u, "call_id", ["startAt", "id"], "text").select("call_id", F.sha2("text", 256).alias("text_hash")).join(n, "call_id")


@query("kept_labels", "SELECT call_id, array_to_string(list_filter(symptom, lambda x: x IN (" + ",".join(f"'{s}'" for s in scalar.SYMPTOMS) + ")), ';') AS symptoms FROM call_labels")
def kept_labels(spark, sf):
    return table(spark, sf, "call_labels").select("call_id", F.array_join(text.kept_labels(F.col("symptom"), scalar.SYMPTOMS), ";").alias("symptoms"))


@query("region_filter", "SELECT call_id, address FROM call_labels WHERE address LIKE '%서울%'")
def region_filter(spark, sf):
    return table(spark, sf, "call_labels").where(text.in_region(F.col("address"))).select("call_id", "address")


@query("region_report", "SELECT CASE WHEN address IS NULL OR trim(address) = '' THEN 'no_address' WHEN address LIKE '%서울%' THEN 'region' ELSE 'other' END AS region, count(*) AS n FROM call_labels GROUP BY 1")
def region_report(spark, sf):
    return text.region_report(table(spark, sf, "call_labels"), "address")


@query("region_pairs", f"SELECT l.call_id AS call_id, h.size_bytes AS size_bytes FROM {ONE_LABEL} l JOIN (SELECT file_ref, max(size_bytes) AS size_bytes FROM audio_headers GROUP BY 1) h ON h.file_ref = l.call_id WHERE l.address LIKE '%서울%'")
def region_pairs(spark, sf):
    """Pairs of label and recording whose address lies in the region."""
    h = table(spark, sf, "audio_headers").groupBy(F.col("file_ref").alias("call_id")).agg(F.max("size_bytes").alias("size_bytes"))
    return _labels(spark, sf).where(text.in_region(F.col("address"))).select("call_id").join(h, "call_id")


_REASON = f"CASE WHEN startAt IS NULL OR endAt IS NULL THEN 'missing' WHEN startAt < 0 THEN 'negative' WHEN endAt <= startAt THEN 'reversed' WHEN {SIDE_SQL} = 'unknown' THEN 'speaker' END"


def _reasons(spark, sf):
    return text.rejection_reasons(
        table(spark, sf, "utterances"),
        missing=F.col("startAt").isNull() | F.col("endAt").isNull(),
        negative=F.col("startAt") < 0,
        reversed=F.col("endAt") <= F.col("startAt"),
        speaker=side() == "unknown",
    )


@query("valid_segments", f"SELECT DISTINCT id, call_id, startAt, endAt FROM utterances WHERE ({_REASON}) IS NULL")
def valid_segments(spark, sf):
    return _reasons(spark, sf).where("reason is null").select("id", "call_id", "startAt", "endAt").distinct()


@query("rejection_reasons", f"SELECT {_REASON} AS reason, count(*) AS n FROM utterances GROUP BY 1")
def rejection_reasons(spark, sf):
    return _reasons(spark, sf).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_WAV = "(SELECT file_ref AS call_id, max(duration_s) AS wav_s FROM audio_headers GROUP BY 1)"


def _wav(spark, sf):
    return table(spark, sf, "audio_headers").groupBy(F.col("file_ref").alias("call_id")).agg(F.max("duration_s").alias("wav_s"))


@query("bounds_issue", f"SELECT DISTINCT u.id AS id, u.call_id AS call_id FROM utterances u JOIN {_WAV} h USING (call_id) WHERE u.startAt >= 0 AND u.endAt > u.startAt AND u.endAt > h.wav_s * 1000 + 50")
def bounds_issue(spark, sf):
    u = table(spark, sf, "utterances").where(intervals.usable()).select("id", "call_id", "endAt")
    return u.join(_wav(spark, sf), "call_id").where(F.col("endAt") > F.col("wav_s") * 1000 + 50).select("id", "call_id").distinct()


@query("drift_flag", f"SELECT l.call_id AS call_id, round(l.endAt / 1000.0 - h.wav_s, 6) AS drift_s, abs(round(l.endAt / 1000.0 - h.wav_s, 6)) > 0.02 AS flagged FROM {ONE_LABEL} l JOIN {_WAV} h USING (call_id)")
def drift_flag(spark, sf):
    d = F.round(scalar.drift(F.col("endAt"), F.col("wav_s")), 6)
    return _labels(spark, sf).join(_wav(spark, sf), "call_id").select("call_id", d.alias("drift_s"), (F.abs(d) > 0.02).alias("flagged"))


_SP = f"(SELECT DISTINCT call_id, startAt AS s, endAt AS e FROM utterances WHERE startAt >= 0 AND endAt > startAt AND {SIDE_SQL} = '{{}}')"
_ISL = "(SELECT call_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, max(e) OVER (PARTITION BY call_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {})) GROUP BY call_id, k)"


def _merged(spark, sf, of):
    u = table(spark, sf, "utterances").where(side() == of)
    return intervals.periods(u, ["call_id"]).select("call_id", F.col("period_start").alias("start_ms"), F.col("period_end").alias("end_ms"))


@query("interval_union", f"SELECT call_id, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS union_ms FROM {_ISL.format(_SP.format('reporter'))} GROUP BY call_id")
def interval_union(spark, sf):
    return _merged(spark, sf, "reporter").groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("union_ms"))


@query("interval_overlap", f"SELECT a.call_id AS call_id, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS overlap_ms FROM {_ISL.format(_SP.format('reporter'))} a JOIN {_ISL.format(_SP.format('dispatcher'))} b ON a.call_id = b.call_id AND a.s < b.e AND b.s < a.e GROUP BY a.call_id")
def interval_overlap(spark, sf):
    """Time in which both sides speak, after each side's intervals are merged. The join is bucketed by minute, so a
    call of any length is spread."""
    return intervals.bucketed_overlap(_merged(spark, sf, "reporter"), _merged(spark, sf, "dispatcher"), ["call_id"])


@query("whitespace_norm", "SELECT id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS clean FROM " + _U + " WHERE text IS NOT NULL")
def whitespace_norm(spark, sf):
    return once(spark, sf).where("text is not null").select("id", scalar.squeeze(F.col("text")).alias("clean"))


def _hits(words):
    return " + ".join(f"CAST(contains(text, '{w}') AS INTEGER)" for w in words)


@query("role_guess", f"SELECT id, CASE WHEN d >= r AND d > 0 THEN 'dispatcher' WHEN r > 0 THEN 'reporter' END AS role FROM (SELECT id, coalesce({_hits(scalar.DISPATCHER_WORDS)}, 0) d, coalesce({_hits(scalar.REPORTER_WORDS)}, 0) r FROM {_U})")
def role_guess(spark, sf):
    return once(spark, sf).select("id", scalar.guess_role(F.col("text")).alias("role"))


@query("prefix_token", "SELECT call_id, split_part(stem, '_', 1) AS prefix, split_part(stem, '_', 2) AS token FROM mission1_manifest")
def prefix_token(spark, sf):
    return table(spark, sf, "mission1_manifest").select("call_id", scalar.prefix_token(F.col("stem")).alias("prefix"), F.split_part("stem", F.lit("_"), F.lit(2)).alias("token"))


@query("path_parts", r"SELECT DISTINCT wav_path, regexp_extract(wav_path, '([^/\\]*)$', 1) AS name, regexp_replace(regexp_extract(wav_path, '([^/\\]*)$', 1), '\.[^.]*$', '') AS stem, lower(regexp_extract(wav_path, '(\.[^.]*)$', 1)) AS suffix, NOT starts_with(wav_path, '/') AS safe FROM mission1_manifest WHERE wav_path IS NOT NULL")
def path_parts(spark, sf):
    p = F.col("wav_path")
    m = table(spark, sf, "mission1_manifest").where("wav_path is not null").select("wav_path").distinct()
    return m.select("wav_path", scalar.file_name(p).alias("name"), scalar.file_stem(p).alias("stem"), scalar.file_suffix(p).alias("suffix"), scalar.safe_path(p).alias("safe"))


@query("text_hash", "SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL")
def text_hash(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))


@query("nfc_hash", "SELECT doc_id, sha256(nfc_normalize(text)) AS h FROM documents WHERE text IS NOT NULL")
def nfc_hash(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2(scalar.nfc("text"), 256).alias("h"))


@query("edge_hash", "SELECT doc_id, sha256(substr(text, 1, 64) || substr(text, greatest(1, length(text) - 63), 64)) AS h FROM documents WHERE text IS NOT NULL")
def edge_hash(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", scalar.edge_hash(F.col("text"), 64).alias("h"))


@query("half_even_index", f"SELECT DISTINCT id, CAST(greatest(0, round_even(startAt / 1000.0::DOUBLE * 8000, 0)) AS BIGINT) AS a, CAST(greatest(0, round_even(endAt / 1000.0::DOUBLE * 8000, 0)) AS BIGINT) AS b, (endAt - startAt) / 1000.0::DOUBLE AS seconds FROM utterances WHERE startAt >= 0 AND endAt > startAt")
def half_even_index(spark, sf):
    u = table(spark, sf, "utterances").where(intervals.usable())
    return u.select("id", scalar.sample_index(F.col("startAt"), 8000).alias("a"), scalar.sample_index(F.col("endAt"), 8000).alias("b"), scalar.seconds(F.col("startAt"), F.col("endAt")).alias("seconds")).distinct()


@query("safe_ratio", "SELECT call_id, round(coalesce(failed_segments / nullif(too_short_segments, 0), 0), 9) AS r0, round(failed_segments / nullif(too_short_segments, 0), 9) AS r1 FROM benchmark_calls")
def safe_ratio(spark, sf):
    a, b = F.col("failed_segments"), F.col("too_short_segments")
    return table(spark, sf, "benchmark_calls").select("call_id", F.round(scalar.safe_ratio(a, b), 9).alias("r0"), F.round(scalar.safe_ratio(a, b, None), 9).alias("r1"))


@query("count_bins", "SELECT CASE WHEN n_segments < 1 THEN NULL WHEN n_segments < 6 THEN '[1,6)' WHEN n_segments < 11 THEN '[6,11)' WHEN n_segments < 21 THEN '[11,21)' WHEN n_segments < 41 THEN '[21,41)' WHEN n_segments IS NOT NULL THEN '[41,inf)' END AS bin, count(*) AS n FROM calls GROUP BY 1")
def count_bins(spark, sf):
    return table(spark, sf, "calls").groupBy(scalar.bin_label(F.col("n_segments"), [1, 6, 11, 21, 41]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("scale_clip", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(least(1, greatest(0, (x * 40 + 80) / 80)), 6) AS scaled FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def scale_clip(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return e.select("vec_id", "pos", F.round(scalar.scale_clip(F.col("x").cast("double") * 40), 6).alias("scaled"))


@query("head_tail", "SELECT doc_id, sha256(array_to_string(CASE WHEN len(w) <= 30 THEN w ELSE list_concat(w[1:15], w[-15:]) END, ' ')) AS h, CAST(least(len(w), 30) AS BIGINT) AS n FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL)")
def head_tail(spark, sf):
    w = scalar.head_tail(F.split("text", " "), 15, 15)
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2(F.array_join(w, " "), 256).alias("h"), F.size(w).cast("bigint").alias("n"))


@query("first_items", "SELECT doc_id, sha256(array_to_string(string_split(text, ' ')[1:20], ' ')) AS h FROM documents WHERE text IS NOT NULL")
def first_items(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2(F.array_join(scalar.first_items(F.split("text", " "), 20), " "), 256).alias("h"))


@query("speaker_texts", f"SELECT call_id, sha256(string_agg(text, ' ' ORDER BY startAt, id)) AS h, count(*) AS n FROM {_U} WHERE {SIDE_SQL} = 'reporter' AND text <> '' AND startAt IS NOT NULL GROUP BY call_id")
def speaker_texts(spark, sf):
    """The texts of one speaker that are not empty, in order."""
    u = once(spark, sf).where("startAt is not null").withColumn("sp", (side() == "reporter").cast("int"))
    nested = u.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("startAt", "id", "text", F.col("sp").alias("speaker")))).alias("utterances"))
    t = text.spoken_texts(F.col("utterances"), 1)
    return nested.select("call_id", F.sha2(F.array_join(t, " "), 256).alias("h"), F.size(t).cast("bigint").alias("n")).where("n > 0")


@query("list_scalars", "SELECT call_id, list_contains(symptom, '복통') AS has, CAST(len(list_filter(symptom, lambda x: x = '기타')) AS INTEGER) AS n_other, CAST(len(symptom) AS INTEGER) AS n FROM call_labels")
def list_scalars(spark, sf):
    s = F.col("symptom")
    return table(spark, sf, "call_labels").select("call_id", F.array_contains(s, "복통").alias("has"), scalar.count_value(s, "기타").alias("n_other"), F.size(s).alias("n"))


@query("argmax_pair", "SELECT vec_id, CASE WHEN embedding[2] > embedding[1] THEN 'M' ELSE 'F' END AS pick, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS top FROM embeddings")
def argmax_pair(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", scalar.pick_of_two(e).alias("pick"), scalar.argmax_index(e).alias("top"))


@query("vector_softmax", "SELECT vec_id, round(exp(embedding[1]::DOUBLE) / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))), 9) AS p, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 9) AS s FROM embeddings")
def vector_softmax(spark, sf):
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", F.round(scalar.softmax(e)[0], 9).alias("p"), F.round(scalar.sigmoid(e[0]), 9).alias("s"))


@query("pre_emphasis", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(x - 0.97 * coalesce(lag(x) OVER (PARTITION BY vec_id ORDER BY i), 0), 6) AS y FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def pre_emphasis(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(signals.pre_emphasis(F.col("embedding").cast("array<double>"))).alias("pos", "y"))
    return e.select("vec_id", "pos", F.round("y", 6).alias("y"))


@query("sliding_windows", "SELECT vec_id, CAST(g.s AS INTEGER) AS first, round(list_sum(list_transform(embedding[g.s + 1:g.s + 24], lambda x: x::DOUBLE)), 5) AS total FROM embeddings, (SELECT unnest([0, 10, 20, 30, 40]) AS s) g")
def sliding_windows(spark, sf):
    """Windows of 24 with stride 10 over vectors of 64; the last one reaches the end."""
    a = F.col("embedding").cast("array<double>")
    w = F.arrays_zip(signals.window_starts(F.size(a), 24, 10).alias("first"), signals.windows(a, 24, 10).alias("w"))
    e = table(spark, sf, "embeddings").select("vec_id", F.explode(w).alias("z"))
    return e.select("vec_id", F.col("z.first").alias("first"), F.round(F.aggregate("z.w", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("frame_starts", "SELECT call_id, CAST(count(*) AS BIGINT) AS n, CAST(max(s) AS BIGINT) AS last FROM (SELECT file_ref AS call_id, unnest(range(0, greatest(frames - 200, 0) + 1, 80)) AS s FROM audio_headers WHERE frames IS NOT NULL AND riff_status = 'ok') GROUP BY call_id")
def frame_starts(spark, sf):
    h = table(spark, sf, "audio_headers").where("frames is not null and riff_status = 'ok'")
    s = signals.frame_starts(F.col("frames").cast("int"), 200, 80)
    return h.select(F.col("file_ref").alias("call_id"), F.size(s).cast("bigint").alias("c"), F.array_max(s).cast("bigint").alias("m")).groupBy("call_id").agg(F.sum("c").alias("n"), F.max("m").alias("last"))


@query("pad_trim", "SELECT vec_id, CAST(16 AS INTEGER) AS n_trim, round(list_sum(list_transform(embedding[25:40], lambda x: x::DOUBLE)), 5) AS mid, CAST(100 AS INTEGER) AS n_pad, round(embedding[1]::DOUBLE, 6) AS at36 FROM embeddings")
def pad_trim(spark, sf):
    """The middle 16 of a vector, and the vector padded to 100 with its first value at place 36 (counted from 0)."""
    a = F.col("embedding")
    t, p = signals.trim(a, 16, "center"), signals.pad(a, 100, "start")
    return table(spark, sf, "embeddings").select("vec_id", F.size(t).alias("n_trim"), F.round(F.aggregate(t.cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 5).alias("mid"), F.size(p).alias("n_pad"), F.round(p[36].cast("double"), 6).alias("at36"))


@query("crop_segment", "SELECT vec_id, CAST(len(embedding[11:30]) AS INTEGER) AS n, round(list_sum(list_transform(embedding[11:30], lambda x: x::DOUBLE)), 5) AS total, CAST(len(embedding[61:64]) AS INTEGER) AS clipped FROM embeddings")
def crop_segment(spark, sf):
    a = F.col("embedding").cast("array<double>")
    c, d = signals.crop(a, F.lit(10), F.lit(30)), signals.crop(a, F.lit(60), F.lit(90))
    return table(spark, sf, "embeddings").select("vec_id", F.size(c).alias("n"), F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.size(d).alias("clipped"))


@query("chunk_lengths", "WITH k AS (SELECT file_ref AS call_id, frames, CAST(greatest(1, ceil(frames / 120000.0::DOUBLE)) AS BIGINT) AS k FROM audio_headers WHERE frames > 0) SELECT call_id, k AS n_parts, frames // k + CASE WHEN frames % k > 0 THEN 1 ELSE 0 END AS longest FROM k")
def chunk_lengths(spark, sf):
    h = table(spark, sf, "audio_headers").where("frames > 0")
    p = balanced_parts(F.col("frames"), 120_000)
    return h.select(F.col("file_ref").alias("call_id"), F.size(p).cast("bigint").alias("n_parts"), F.array_max(p).alias("longest"))


@query(
    "char_tfidf",
    """WITH d AS (SELECT item_id, text FROM eval_items WHERE text IS NOT NULL),
g AS (SELECT item_id, substr(text, i, k) AS term FROM d, (SELECT unnest([2, 3]) AS k), LATERAL (SELECT unnest(range(1, length(text) - k + 2)) AS i)),
tf AS (SELECT item_id, term, count(*) AS tf FROM g GROUP BY 1, 2),
v AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT 3000),
w AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term))
SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 7) AS weight FROM w""",
)
def char_tfidf(spark, sf):
    t = text.char_tfidf(table(spark, sf, "eval_items"), "item_id", "text", 2, 3, 2, 3000)
    return t.select("item_id", "term", F.round("weight", 7).alias("weight"))


@query("document_tfidf")
def document_tfidf(spark, sf):
    """The whole job of ML5: every document, 2-5-grams, terms of two documents or more, the 150,000 most frequent."""
    t = text.char_tfidf(table(spark, sf, "documents"), "doc_id", "text", 2, 5, 2, 150_000)
    return t.select("doc_id", "term", F.round("weight", 7).alias("weight"))


@query("sum_and_union", f"SELECT call_id, a.ms AS sum_ms, b.ms AS union_ms FROM (SELECT call_id, CAST(sum(e - s) AS BIGINT) AS ms FROM {_SP.format('reporter')} GROUP BY 1) a JOIN (SELECT call_id, CAST(sum(e - s) AS BIGINT) AS ms FROM {_ISL.format(_SP.format('reporter'))} GROUP BY 1) b USING (call_id)")
def sum_and_union(spark, sf):
    """Two measures side by side: the sum of the reporter's segments and the length of their union."""
    u = table(spark, sf, "utterances").where(side() == "reporter").where(intervals.usable()).select("call_id", "startAt", "endAt").distinct()
    total = u.groupBy("call_id").agg(F.sum(F.col("endAt") - F.col("startAt")).alias("sum_ms"))
    return total.join(interval_union(spark, sf).select("call_id", "union_ms"), "call_id")


# of rows (path, type, value): how often each path occurs, its types, five least values, how many there are
SCHEMA_SQL = """, t AS (SELECT path, sum(n) AS n, string_agg(type || ':' || n, ',' ORDER BY type || ':' || n) AS types FROM (SELECT path, type, count(*) AS n FROM walked GROUP BY 1, 2) GROUP BY path),
v AS (SELECT DISTINCT path, value FROM walked WHERE value IS NOT NULL),
x AS (SELECT path, string_agg(value, '|' ORDER BY value) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY value) AS r FROM v) WHERE r <= 5 GROUP BY path),
d AS (SELECT path, count(*) AS n_distinct FROM v GROUP BY path)
SELECT path, CAST(n AS BIGINT) AS n, types, examples, n_distinct, n_distinct <= 30 AS listed FROM t LEFT JOIN x USING (path) LEFT JOIN d USING (path)"""


@query(
    "json_walk",
    """WITH k AS (SELECT unnest(json_keys(props)) AS path, props FROM events),
walked AS (SELECT path, CASE json_type(props, '$.' || path) WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'null' END AS type, json_extract_string(props, '$.' || path) AS value FROM k)"""
    + SCHEMA_SQL,
)
def json_walk(spark, sf):
    """How often each path of the events' JSON occurs, with its types and least examples."""
    from callweave.operators import stats

    return stats.schema_stats(udfs.walked(table(spark, sf, "events"), "event_id", "props"))


@query("mfcc_features")
def mfcc_features(spark, sf):
    """26 cepstral features of vectors taken as waveforms."""
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(udfs.mfcc_features("embedding")).alias("pos", "value"))


@query("log_mel_features")
def log_mel_features(spark, sf):
    f = udfs.log_mel_features("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(f).alias("pos", "value")).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"))


@query("acoustic_features")
def acoustic_features(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", udfs.acoustic_features("embedding").alias("a")).select("vec_id", "a.*")


@query("level_features")
def level_features(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", udfs.level_features("embedding").alias("a")).select("vec_id", "a.*")
