"""Sources and sinks over the given tables: what they hold is written through a sink into the shared folder, read back by
a reader, and compared by SQL with the tables themselves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from callweave.functions import scalar
from callweave.operators import checks, intervals, pairing, sampling
from callweave.queries.pairing import ONE_LABEL, _labels
from callweave.queries.registry import query, table
from callweave.session import shared_path
from callweave.sources import files, readers, sinks
from callweave.streaming import incremental

_UTT = "(SELECT call_id, count(*) AS n, min(startAt) AS first FROM (SELECT DISTINCT ON (id) call_id, id, startAt FROM utterances WHERE startAt >= 0 AND endAt > startAt ORDER BY id, loaded_at, call_id, startAt) GROUP BY call_id)"


def _label_files(spark, sf):
    """Every call's label document with its usable utterances as a JSON file of its own, in one of 256 folders; a call
    without any has no list, and where the address is not in the region the file breaks off."""
    u = table(spark, sf, "utterances").where(intervals.usable()).groupBy("id").agg(F.min(F.struct("loaded_at", "call_id", "startAt", "endAt", "text")).alias("r")).select("id", "r.*").drop("loaded_at")
    u = u.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("startAt", "endAt", "id", "text"))).alias("utterances"))
    lab = _labels(spark, sf)
    doc = F.to_json(F.struct(*[F.col(c) for c in lab.columns if c != "call_id"], "utterances"))
    root = shared_path(spark, "labels")
    files.write_files(lab.join(u, "call_id", "left").select(F.concat(F.substring(F.md5(F.col("call_id")), 1, 2), F.lit("/"), "call_id", F.lit(".json")).alias("n"), F.when(~F.coalesce(F.col("address").contains("서울"), F.lit(False)), F.substring(doc, 1, 20)).otherwise(doc).alias("d")), root, "n", "d")
    return root


@query("label_files", f"SELECT l.call_id AS call_id, CASE WHEN l.address NOT LIKE '%서울%' OR l.address IS NULL THEN 'json' WHEN u.n IS NULL THEN 'no_utterances' END AS error, CASE WHEN u.n IS NOT NULL AND l.address LIKE '%서울%' THEN l.gender END AS gender, CASE WHEN l.address LIKE '%서울%' THEN u.n END AS n_utterances, CASE WHEN l.address LIKE '%서울%' THEN u.first END AS first_ms FROM {ONE_LABEL} l LEFT JOIN {_UTT} u USING (call_id)")
def label_files(spark, sf):
    """Label documents read back from files, those with errors kept."""
    d = readers.label_documents(spark, _label_files(spark, sf))
    return d.select(scalar.file_stem(F.col("path")).alias("call_id"), "error", "doc.gender", F.when(F.col("doc").isNotNull(), F.size("doc.utterances")).cast("bigint").alias("n_utterances"), F.array_min(F.transform("doc.utterances", lambda x: x["startAt"])).alias("first_ms"))


@query("readable_labels", f"SELECT l.call_id AS call_id, l.urgencyLevel AS urgency FROM {ONE_LABEL} l JOIN {_UTT} u USING (call_id) WHERE l.address LIKE '%서울%'")
def readable_labels(spark, sf):
    d = readers.readable(readers.label_documents(spark, _label_files(spark, sf)))
    return d.select(scalar.file_stem(F.col("path")).alias("call_id"), F.col("urgencyLevel").alias("urgency"))


@query("label_issues", f"SELECT l.call_id AS call_id, CASE WHEN l.address NOT LIKE '%서울%' OR l.address IS NULL THEN 'json_json' ELSE 'json_no_utterances' END AS issue FROM {ONE_LABEL} l LEFT JOIN {_UTT} u USING (call_id) WHERE u.n IS NULL OR l.address NOT LIKE '%서울%' OR l.address IS NULL")
def label_issues(spark, sf):
    i = readers.label_issues(readers.label_documents(spark, _label_files(spark, sf)))
    return i.select(scalar.file_stem(F.col("file_ref")).alias("call_id"), "issue")


@query("missing_label_files", "SELECT DISTINCT call_id, 'label_missing' AS issue FROM mission1_manifest WHERE call_id NOT IN (SELECT call_id FROM call_labels WHERE call_id IS NOT NULL)")
def missing_label_files(spark, sf):
    """Calls of the manifest that no file is there for, by a listing alone."""
    there = files.listing(spark, _label_files(spark, sf), "*.json").select(scalar.file_stem(F.col("path")).alias("call_id"))
    return pairing.missing_keys(table(spark, sf, "mission1_manifest").select("call_id").distinct(), there, "call_id", "label_missing").select("call_id", "issue")


def _item_files(spark, sf):
    root = shared_path(spark, "items")
    e = table(spark, sf, "eval_items").where("item_id is not null and text is not null")
    files.write_files(e.select(F.concat("eval_set", F.lit("/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("n"), "text"), root, "n", "text")
    files.write_files(e.select(F.concat("eval_set", F.lit("/._"), F.col("item_id").cast("string"), F.lit(".txt")).alias("n"), F.lit("x").alias("c")), root, "n", "c")
    return root


@query("listed_files", "SELECT item_id, eval_set AS folder, strlen(text) AS size FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL")
def listed_files(spark, sf):
    f = files.real_files(files.listing(spark, _item_files(spark, sf), "*.txt"))
    return f.select(scalar.file_stem(F.col("path")).cast("bigint").alias("item_id"), scalar.parent_name(F.col("path")).alias("folder"), "size")


@query("side_car_files", "SELECT count(*) AS ignored, count(*) AS kept FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL")
def side_car_files(spark, sf):
    """Files that a scan never shows are counted."""
    return files.ignored_count(files.listing_all(spark, _item_files(spark, sf)))


@query("hashed_files", "SELECT item_id, sha256(text) AS sha256 FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL")
def hashed_files(spark, sf):
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_item_files(spark, sf))
    return checks.file_hashes(raw).select(scalar.file_stem(F.col("path")).cast("bigint").alias("item_id"), "sha256")


_PATHS = "(SELECT DISTINCT replace(wav_path, '\\', '/') AS path FROM calls WHERE wav_path IS NOT NULL)"


def _paths(spark, sf):
    return table(spark, sf, "calls").where("wav_path is not null").select(F.translate("wav_path", "\\", "/").alias("path")).distinct()


@query("keyword_folders", f"SELECT DISTINCT f AS folder, CAST(len(string_split(f, '/')) AS INTEGER) AS depth FROM (SELECT array_to_string(p[1:i], '/') AS f, p[i] AS leaf FROM (SELECT string_split(path, '/') AS p FROM {_PATHS}), LATERAL (SELECT unnest(range(1, len(p))) AS i)) WHERE f <> '' AND lower(leaf) LIKE '%train%'")
def keyword_folders(spark, sf):
    return files.folders_with(_paths(spark, sf), "Train").select("folder", "depth")


@query("shallowest_folder", f"SELECT f AS folder FROM (SELECT DISTINCT array_to_string(p[1:i], '/') AS f, p[i] AS leaf, i FROM (SELECT string_split(path, '/') AS p FROM {_PATHS}), LATERAL (SELECT unnest(range(1, len(p))) AS i)) WHERE f <> '' AND leaf = 'Training' ORDER BY i, f LIMIT 1")
def shallowest_folder(spark, sf):
    return files.split_folder(_paths(spark, sf), "Training").select("folder")


@query("stems", f"SELECT nfc_normalize(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '')) AS stem, array_to_string(list_sort(list(path)), '|') AS paths FROM {_PATHS} GROUP BY 1")
def stems(spark, sf):
    return files.stem_index(_paths(spark, sf)).select("stem", F.array_join("paths", "|").alias("paths"))


@query("csv_round_trip", f"SELECT call_id, nullif(gender, '') AS gender, nullif(array_to_string(symptom, ';'), '') AS symptom FROM {ONE_LABEL}")
def csv_round_trip(spark, sf):
    """Written in order with lists joined, read with a schema."""
    path = shared_path(spark, "csv")
    sinks.write_csv(_labels(spark, sf), path, ["call_id", "gender", "symptom"], ["call_id"])
    return readers.csv_table(spark, path, "call_id string, gender string, symptom string")


@query("csv_columns", f"SELECT call_id, nullif(urgencyLevel, '') AS \"urgencyLevel\" FROM {ONE_LABEL}")
def csv_columns(spark, sf):
    path = shared_path(spark, "csv")
    sinks.write_csv(_labels(spark, sf), path, ["call_id", "gender", "urgencyLevel", "symptom"], ["call_id"])
    return readers.csv_table(spark, path, "call_id string, gender string, urgencyLevel string, symptom string", ["call_id", "urgencyLevel"])


@query("log_round_trip", "SELECT DISTINCT call_id, id, startAt, endAt FROM utterances")
def log_round_trip(spark, sf):
    """Rows appended to a log in two parts, read with a schema."""
    path, u = shared_path(spark, "log"), table(spark, sf, "utterances").select("call_id", "id", "startAt", "endAt").distinct()
    sinks.append_rows(u.where("startAt is not null"), path)
    sinks.append_rows(u.where("startAt is null"), path)
    return readers.jsonl_table(spark, path, "call_id string, id string, startAt bigint, endAt bigint")


def _calls_log(spark, sf, torn):
    """One log of all calls in order of arrival; ``torn``: with half a line at its end."""
    path, c = shared_path(spark, "log"), table(spark, sf, "calls").where("call_id is not null").select("call_id", "partition", F.col("loaded_at").cast("string").alias("at"))
    lines = c.select(F.struct("at", "call_id", "partition").alias("o"), F.to_json(F.struct(*c.columns)).alias("value"))
    if torn:
        end = spark.createDataFrame([("9999", None, None, '{"call_id":')], "at string, call_id string, partition string, value string")
        lines = lines.unionByName(end.select(F.struct("at", "call_id", "partition").alias("o"), "value"))
    lines.orderBy("o").select("value").coalesce(1).write.text(path)
    return path


@query("log_latest", "SELECT call_id, arg_max(coalesce(partition, '-'), (loaded_at, coalesce(partition, ''))) AS partition FROM calls WHERE call_id IS NOT NULL GROUP BY call_id")
def log_latest(spark, sf):
    """The last line of each call counts."""
    d = readers.jsonl_latest(spark, _calls_log(spark, sf, False), "call_id string, partition string, at string", "call_id")
    return d.select("call_id", F.coalesce("partition", F.lit("-")).alias("partition"))


@query("log_torn", "SELECT call_id, partition, count(*) AS n FROM calls WHERE call_id IS NOT NULL GROUP BY ALL")
def log_torn(spark, sf):
    """A log whose last line is torn loses that line only."""
    d = readers.jsonl_torn(spark, _calls_log(spark, sf, True), "call_id string, partition string, at string")
    return d.groupBy("call_id", "partition").agg(F.count(F.lit(1)).alias("n"))


def _archives(spark, sf, kind):
    """The items in eight archives, each made by one task: ``set_lang_id.json`` below the set's folder."""
    import io
    import tarfile
    import zipfile

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buffer, names = io.BytesIO(), []
        z = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) if kind == "zip" else tarfile.open(fileobj=buffer, mode="w:gz")
        for b in batches:
            for n, c in zip(b["n"], b["c"]):
                names.append(n)
                if kind == "zip":
                    z.writestr(n, bytes(c))
                    z.writestr("__MACOSX/._" + n.rsplit("/", 1)[-1], b"x")
                else:
                    i = tarfile.TarInfo(n)
                    i.size = len(c)
                    z.addfile(i, io.BytesIO(bytes(c)))
        z.close()
        if names:
            yield pd.DataFrame({"n": [f"{min(names).replace('/', '-')}.{kind}"], "c": [buffer.getvalue()]})

    e = table(spark, sf, "eval_items").where("item_id is not null and text is not null")
    name = F.format_string("%s/%s_%s_%d.json", "eval_set", F.regexp_replace("eval_set", "_", "-"), "lang", "item_id")
    content = F.concat(F.lit('{"id":"'), F.col("item_id").cast("string"), F.lit('"}')) if kind == "zip" else F.col("text")
    made = e.select(name.alias("n"), content.cast("binary").alias("c")).repartition(8, "n").mapInPandas(pack, "n string, c binary")
    root = shared_path(spark, kind)
    files.write_files(made, root, "n", "c")
    return root


@query("zip_members", "SELECT item_id, strlen('{\"id\":\"' || item_id || '\"}') AS size FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL")
def zip_members(spark, sf):
    m = readers.checked_members(readers.zip_members(spark, _archives(spark, sf, "zip")))
    return m.select(F.get_json_object(F.decode("content", "UTF-8"), "$.id").cast("bigint").alias("item_id"), "size")


@query("member_audit", "SELECT lang AS token, count(*) AS n, CAST(0 AS BIGINT) AS n_unreadable, CAST(sum(strlen('{\"id\":\"' || item_id || '\"}')) AS BIGINT) AS bytes FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL GROUP BY lang")
def member_audit(spark, sf):
    return readers.member_audit(readers.zip_members(spark, _archives(spark, sf, "zip")))


@query("tar_members", "SELECT item_id, sha256(text) AS h FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL")
def tar_members(spark, sf):
    m = readers.tar_members(spark, _archives(spark, sf, "tar"))
    return m.select(F.regexp_extract("member", r"_(\d+)\.json$", 1).cast("bigint").alias("item_id"), F.sha2("content", 256).alias("h"))


_SUM64 = "round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5)"


@query("npz_rows", f"SELECT vec_id, label, {_SUM64} AS total FROM embeddings")
def npz_rows(spark, sf):
    """Arrays of NPZ files, one a partition, as rows with an explicit key."""
    root = shared_path(spark, "npz")

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for b in batches:
            if len(b):
                f = io.BytesIO()
                np.savez(f, ids=b["vec_id"].to_numpy(), label=b["label"].to_numpy(), x=np.vstack(b["embedding"].to_numpy()))
                yield pd.DataFrame({"n": [f"{b['vec_id'].min()}.npz"], "c": [f.getvalue()]})

    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"), "embedding").repartition(4)
    files.write_files(e.mapInPandas(save, "n string, c binary"), root, "n", "c")
    paths = [r[0] for r in files.listing(spark, root, "*.npz").select(F.regexp_replace("path", "^file:/+", "/")).collect()]
    d = readers.convert_npz(spark, paths, "ids", {"label": "label", "x": "x"}, "id bigint, label bigint, x array<float>")
    return d.select(F.col("id").alias("vec_id"), F.col("label").cast(dict(table(spark, sf, "embeddings").dtypes)["label"]).alias("label"), F.round(F.aggregate(F.col("x").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("written_shards", "SELECT l_returnflag, count(*) AS n, CAST(true AS BOOLEAN) AS bounded FROM lineitem GROUP BY l_returnflag")
def written_shards(spark, sf):
    """Files of at most 5,000 rows; the whole table is there again."""
    path = shared_path(spark, "shards")
    sinks.write_shards(table(spark, sf, "lineitem"), path, 5000)
    d = spark.read.parquet(path).select("l_returnflag", F.col("_metadata.file_path").alias("f"))
    each = d.groupBy("f", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    most = each.groupBy("f").agg(F.sum("n").alias("m")).agg((F.max("m") <= 5000).alias("bounded"))
    return each.groupBy("l_returnflag").agg(F.sum("n").alias("n")).join(F.broadcast(most))


@query("prefix_folders", "SELECT substr(call_id, 1, 2) AS prefix, count(*) AS n FROM mission1_manifest GROUP BY 1")
def prefix_folders(spark, sf):
    path = shared_path(spark, "prefix")
    sinks.write_by_prefix(table(spark, sf, "mission1_manifest").select("call_id"), path, "call_id")
    return spark.read.schema("call_id string, prefix string").parquet(path).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


@query("written_predictions", "SELECT vec_id, CASE WHEN embedding[2] > embedding[1] THEN 'M' ELSE 'F' END AS prediction FROM embeddings")
def written_predictions(spark, sf):
    path = shared_path(spark, "predictions")
    sinks.write_predictions(table(spark, sf, "embeddings").select("vec_id", scalar.pick_of_two(F.col("embedding")).alias("prediction")), path)
    return spark.read.parquet(path)


@query("report_rows", "SELECT partition, count(*) AS n FROM calls WHERE partition IS NOT NULL GROUP BY partition")
def report_rows(spark, sf):
    """A small result as a JSON report of the driver's, read back."""
    root = shared_path(spark, "report")
    if not root.startswith(("file:", "/")):
        raise RuntimeError("a report is written by the driver, to a folder that it can open")
    local = root.removeprefix("file://")
    sinks.empty_folder(local)
    sinks.report(table(spark, sf, "calls").where("partition is not null").groupBy("partition").agg(F.count(F.lit(1)).alias("n")), f"{local}/report.json")
    sinks.bundle([f"{local}/report.json"], f"{local}/bundle.zip")
    rows = readers.zip_members(spark, f"{root}/bundle.zip").where("name = 'report.json'").select(F.from_json(F.decode("content", "UTF-8"), "rows array<struct<partition:string,n:bigint>>").alias("r"))
    return rows.select(F.inline("r.rows"))


_PCM = "list_transform(embedding, lambda x: greatest(-32768, least(32767, floor(x::DOUBLE * 8192))))"


def _wav_files(spark, sf):
    """Every vector as a WAV file of 8 kHz and 16 bits."""
    import struct

    def wav(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            made = []
            for x in b["embedding"]:
                raw = np.clip(np.floor(np.asarray(x, dtype=float) * 8192), -32768, 32767).astype("<i2").tobytes()
                fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 16000, 2, 16)
                made.append(b"RIFF" + struct.pack("<I", 4 + len(fmt) + 8 + len(raw)) + b"WAVE" + fmt + b"data" + struct.pack("<I", len(raw)) + raw)
            yield pd.DataFrame({"n": [f"{i // 1000}/{i}.wav" for i in b["vec_id"]], "c": made})

    root = shared_path(spark, "wav")
    files.write_files(table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(wav, "n string, c binary"), root, "n", "c")
    return root


def _vec(path="path"):
    return scalar.file_stem(F.col(path)).cast("bigint").alias("vec_id")


@query("wav_files", "SELECT vec_id, CAST(8000 AS INTEGER) AS sample_rate, CAST(1 AS INTEGER) AS channels, CAST(len(embedding) AS BIGINT) AS frames, len(embedding) / 8000.0::DOUBLE AS duration_s, 'PCM_16' AS subtype, 'ok' AS riff_status FROM embeddings")
def wav_files(spark, sf):
    h = files.wav_headers(spark, _wav_files(spark, sf))
    return h.select(_vec(), "sample_rate", "channels", "frames", "duration_s", "subtype", "riff_status")


@query("wav_samples", f"SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(list_sum({_PCM}) AS BIGINT) AS total FROM embeddings")
def wav_samples(spark, sf):
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_wav_files(spark, sf))
    w = raw.select(_vec(), files.waveform("content").alias("w"))
    return w.select("vec_id", F.size("w").alias("n"), F.aggregate("w", F.lit(0.0), lambda a, x: a + x.cast("double") * 32768).cast("bigint").alias("total"))


@query("wav_crops", f"SELECT vec_id, CAST(0 AS INTEGER) AS segment, CAST(list_sum({_PCM}[9:32]) AS BIGINT) AS total, CAST(NULL AS VARCHAR) AS error FROM embeddings UNION ALL SELECT vec_id, CAST(1 AS INTEGER), CAST(NULL AS BIGINT), 'Invalid crop' FROM embeddings")
def wav_crops(spark, sf):
    """Two crops of every file, decoded once; one reaches beyond the end."""
    root = _wav_files(spark, sf)
    jobs = files.listing(spark, root, "*.wav").select("path", F.expr("array(named_struct('s', 0.001D, 'e', 0.004D), named_struct('s', 0.0D, 'e', 9.0D))").alias("intervals"))
    c = files.crops(spark, root, jobs)
    return c.select(_vec(), "segment", F.when(F.col("samples").isNotNull(), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * 32768).cast("bigint")).alias("total"), "error")


@query("resumed_run", "SELECT call_id, num_segments FROM (SELECT call_id, max(num_segments) AS num_segments FROM mission1_manifest WHERE call_id IS NOT NULL GROUP BY call_id) WHERE num_segments IS NOT NULL")
def resumed_run(spark, sf):
    """Jobs worked on in two runs, of which the first fails for all calls of women; what has no number fails for good."""
    jobs = table(spark, sf, "mission1_manifest").where("call_id is not null").groupBy("call_id").agg(F.max("num_segments").alias("num_segments"), F.max("gender").alias("gender"))
    path, none = shared_path(spark, "run"), F.when(F.col("num_segments").isNull(), "no number")
    name = checks.identity(jobs, {"work": "segments"})
    for fault in (F.when(F.col("gender") == "F", "not yet"), F.lit(None).cast("string")):
        incremental.run_pending(jobs, "call_id", lambda t, f=fault: t.select("call_id", "num_segments", F.coalesce(f, none).alias("error")), path, name)
    return incremental.committed(spark, path).select("call_id", "num_segments")


@query("upserted", "SELECT call_id, count(*) AS n FROM (SELECT DISTINCT call_id, id FROM utterances WHERE id IS NOT NULL) GROUP BY call_id")
def upserted(spark, sf):
    """Batches of a stream into an idempotent sink: the second is played twice, and brings rows that are there already."""
    path, u = shared_path(spark, "sink"), table(spark, sf, "utterances").where("id is not null").select("call_id", "id")
    sink = incremental.upsert_batch(path, "id", 16)
    sink(u.where("id < '8'"), 0)
    sink(u, 1)
    sink(u, 1)
    return spark.read.parquet(path).groupBy("call_id").agg(F.count(F.lit(1)).alias("n"))


@query("sample_of_files", "SELECT item_id, CAST(row_number() OVER (ORDER BY sha256('files' || item_id), CAST(item_id AS VARCHAR)) AS BIGINT) AS position FROM eval_items")
def sample_of_files(spark, sf):
    """Items in a salted order, as a bounded sample of files takes them."""
    e = table(spark, sf, "eval_items").select(F.col("item_id").cast("string").alias("k"))
    return sampling.salted_positions(e, "k", "files").select(F.col("k").cast("bigint").alias("item_id"), "position")


@query("writers_and_gates", "SELECT true AS second_writer_refused, true AS freed, true AS closed_at_first, true AS kept_closed, true AS opened, count(*) AS n FROM benchmark_calls WHERE model_chunks IS NULL OR model_chunks >= 0")
def writers_and_gates(spark, sf):
    """One writer at a time; a stage that waits for the one before it, which passes once its checks hold."""
    path, b = shared_path(spark, "state"), table(spark, sf, "benchmark_calls")

    def refused(act) -> bool:
        try:
            act()
            return False
        except checks.ContractError:
            return True

    def write():
        with incremental.single_writer(spark, path):
            pass

    with incremental.single_writer(spark, path):
        second = refused(write)
    bad = b.where("model_chunks < 0").count()
    closed = refused(lambda: incremental.need_gate(spark, path, "counted"))
    kept = refused(lambda: incremental.pass_gate(spark, path, "counted", "a check fails")) and refused(lambda: incremental.need_gate(spark, path, "counted"))
    incremental.pass_gate(spark, path, "counted", f"{bad} negative counts" if bad else None)
    opened = not refused(lambda: incremental.need_gate(spark, path, "counted"))
    return spark.createDataFrame([(second, not refused(write), closed, kept, opened, b.count() - bad)], "second_writer_refused boolean, freed boolean, closed_at_first boolean, kept_closed boolean, opened boolean, n bigint")
