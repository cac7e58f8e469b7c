"""End-to-end plans: the training manifests, the audit of labels against audio, the projected text table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.scalar import SYMPTOMS, file_stem
from callweave.operators.pairing import pair_by_key
from callweave.operators.text import document_text, in_region, kept_labels


def label_table(labels: DataFrame) -> DataFrame:
    """Parsed label documents with their stem."""
    return labels.withColumn("stem", file_stem(F.col("path")))


def speaker_manifest(calls: DataFrame) -> DataFrame:
    """One row an utterance of a known side with its times; text is not among the columns."""
    u = calls.select("stem", "wav_path", F.explode("utterances").alias("u"))
    ok = F.col("u.speaker").isin(0, 1) & (F.col("u.startAt") >= 0) & (F.col("u.endAt") > F.col("u.startAt"))
    return u.where(ok).select("stem", "wav_path", F.col("u.id").alias("utterance_id"), F.col("u.startAt").alias("startAt"), F.col("u.endAt").alias("endAt"), F.col("u.speaker").alias("speaker"))


def reporter_segments(utterances: Column) -> Column:
    keep = F.filter(utterances, lambda u: F.coalesce((u["speaker"] == 1) & (u["startAt"] >= 0) & (u["endAt"] > u["startAt"]), F.lit(False)))
    return F.transform(keep, lambda u: F.array(u["startAt"], u["endAt"]))


def gender_candidates(calls: DataFrame) -> DataFrame:
    """Calls with their reporter segments and the reason why one is left out, or null."""
    c = calls.withColumn("segments", reporter_segments(F.col("utterances")))
    reason = F.when(~F.col("gender").isin("M", "F") | F.col("gender").isNull(), "no_gender").when(F.size("segments") == 0, "no_segment")
    return c.withColumn("reason", reason)


def gender_manifest(calls: DataFrame) -> DataFrame:
    c = gender_candidates(calls).where("reason is null")
    return c.select("stem", "wav_path", "gender", F.to_json("segments").alias("reporter_segments_ms"), F.size("segments").alias("num_segments"))


def symptom_manifest(calls: DataFrame) -> DataFrame:
    """Call texts and their target symptoms; a call keeps its row when none is left."""
    kept = kept_labels(F.col("symptom"), SYMPTOMS)
    return calls.select("stem", F.col("path").alias("json_path"), document_text(F.col("utterances")).alias("text"), F.array_join(kept, ";").alias("symptom_labels"), F.size(kept).alias("num_symptoms"))


def manifests(wav_files: DataFrame, labels: DataFrame, region_only: bool = True) -> dict[str, DataFrame]:
    """The three manifests of all pairs of recording and label. ``labels`` is parsed once: hand over a stored table."""
    wav = wav_files.select(file_stem(F.col("path")).alias("stem"), F.col("path").alias("wav_path"))
    lab = label_table(labels)
    pairs = pair_by_key(wav, lab.select("stem", F.col("path").alias("json_path")), "stem", "wav_path", "json_path").where("wav_path is not null and json_path is not null")
    calls = lab.join(pairs.select("wav_path", F.col("json_path").alias("path")), "path")
    if region_only:
        calls = calls.where(in_region(F.col("address")))
    return {"gender": gender_manifest(calls), "speaker": speaker_manifest(calls), "symptom": symptom_manifest(calls)}


def audit_segments(labels: DataFrame, headers: DataFrame, tolerance_ms: int = 1) -> DataFrame:
    """Every utterance with its faults: ``invalid`` times and ends beyond the recording."""
    u = label_table(labels).select("stem", "gender", F.posexplode("utterances").alias("position", "u"))
    h = headers.select(file_stem(F.col("path")).alias("stem"), F.col("duration_s").alias("wav_s"))
    valid = F.coalesce((F.col("u.startAt") >= 0) & (F.col("u.endAt") > F.col("u.startAt")), F.lit(False))
    return u.join(h, "stem", "left").select(
        "stem",
        "gender",
        "position",
        F.col("u.speaker").alias("speaker"),
        F.col("u.startAt").alias("start_ms"),
        F.col("u.endAt").alias("end_ms"),
        (~valid).alias("invalid"),
        F.coalesce(F.col("u.endAt") > F.col("wav_s") * 1000 + tolerance_ms, F.lit(False)).alias("exceeds_wav"),
    )


def audit_issues(segments: DataFrame, pairs: DataFrame, label_issues: DataFrame) -> DataFrame:
    """One issue log of all rules: unpaired stems, unreadable labels, bad times."""
    unpaired = pairs.select(F.col("stem").alias("file_ref"), F.when(F.col("wav_path").isNull(), "json_only").when(F.col("json_path").isNull(), "wav_only").alias("issue")).where("issue is not null")
    bad = segments.where("invalid").select(F.col("stem").alias("file_ref"), F.lit("invalid_segment_time").alias("issue"))
    late = segments.where("exceeds_wav and not invalid").select(F.col("stem").alias("file_ref"), F.lit("segment_exceeds_wav").alias("issue"))
    return unpaired.unionByName(label_issues.select("file_ref", "issue")).unionByName(bad).unionByName(late)
