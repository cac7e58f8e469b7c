import io
import json
import struct
import tarfile
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.operators.checks import ContractError
from callweave.plans import manifests as mf
from callweave.sources import files, readers, sinks
from callweave.streaming import incremental as inc


def wav_bytes(seconds=1.0, rate=8000, channels=1, value=1000):
    b = io.BytesIO()
    with wave.open(b, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(struct.pack("<h", value) * int(seconds * rate * channels))
    return b.getvalue()


def label(speaker_times, gender="M", address="서울특별시 가구", symptom=("구토", "기타")):
    u = [{"id": str(i), "speaker": s, "startAt": a, "endAt": b, "text": f"말 {i}"} for i, (s, a, b) in enumerate(speaker_times)]
    return {"_id": "x", "gender": gender, "address": address, "endAt": 1000, "symptom": list(symptom), "utterances": u}


TIMES = [(1, 0, 700), (1, 500, 1000), (0, 800, 1100), (1, 50, 20)]


@pytest.fixture
def corpus(tmp_path):
    for split in ("Training", "Validation"):
        for g in "MF":
            d = tmp_path / split / g
            d.mkdir(parents=True)
            (d / f"{split}{g}.wav").write_bytes(wav_bytes())
            (d / f"{split}{g}.json").write_text(json.dumps(label(TIMES, g), ensure_ascii=False), "utf-8")
    (tmp_path / "Training/M/missing.json").write_text("﻿" + json.dumps(label([(1, 3010, 3510)])), "utf-8")
    (tmp_path / "Training/M/._ignored.wav").write_bytes(b"x")
    (tmp_path / "Training/M/cut.wav").write_bytes(wav_bytes()[:-100])
    (tmp_path / "Training/M/broken.json").write_text('{"utterances": [')
    (tmp_path / "Training/M/shape.json").write_text('{"gender": "M"}')
    return tmp_path


def test_lines_are_numbered_over_blocks_and_files(spark, rows, tmp_path):
    for f in range(3):
        (tmp_path / f"{f}.txt").write_text("\n".join(f"{f}-{i}" for i in range(200)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        d = readers.numbered_lines(spark, str(tmp_path))
        assert d.rdd.getNumPartitions() > 3
        assert [(r.line_no, r.value) for r in d.orderBy("line_no").collect()] == [(200 * f + i, f"{f}-{i}") for f in range(3) for i in range(200)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_listing_and_folders(spark, rows, corpus):
    every = files.listing_all(spark, str(corpus)).where("path like '%.wav'")
    assert rows(files.ignored_count(every)) == [(1, 5)]
    f = files.listing(spark, str(corpus), "*.wav")
    assert rows(f) == rows(files.real_files(every)) and files.listing_all(spark, str(corpus / "none")).count() == 0
    assert files.listing(spark, str(corpus / "none")).count() == 0
    assert files.split_folder(files.real_files(f), "M").first().folder.endswith("/Training/M")
    assert files.folders_with(f, "TRAIN").count() == 1
    assert files.stem_index(files.real_files(f)).where("size(paths) = 1").count() == 5


def any_wav(tag, bits, raw, rate=8000, channels=1, extensible=False):
    block = channels * bits // 8
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else tag, channels, rate, rate * block, block, bits)
    if extensible:
        fmt += struct.pack("<HHI", 22, bits, 0) + struct.pack("<H", tag) + bytes(14)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(raw)) + raw
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_other_sample_formats(spark, tmp_path):
    x = np.array([0.0, 0.5, -0.25, 1.0, -1.0])
    made = {
        "FLOAT": any_wav(3, 32, x.astype("<f4").tobytes()),
        "DOUBLE": any_wav(3, 64, x.astype("<f8").tobytes(), extensible=True),
        "PCM_U8": any_wav(1, 8, bytes([128, 192, 96, 255, 0])),
        "PCM_24": any_wav(1, 24, b"".join(int(v * 8388607).to_bytes(3, "little", signed=True) for v in x)),
        "ULAW": any_wav(7, 8, bytes([0xFF, 0x8F, 0x2F, 0x80, 0x00])),
        "ALAW": any_wav(6, 8, bytes([0xD5, 0xBA, 0x2A, 0xAA, 0x55])),
    }
    for name, raw in made.items():
        (tmp_path / f"{name}.wav").write_bytes(raw)
    (tmp_path / "ADPCM.wav").write_bytes(any_wav(2, 4, bytes(8), channels=2))
    (tmp_path / "nofmt.wav").write_bytes(b"RIFF" + struct.pack("<I", 12) + b"WAVEdata" + struct.pack("<I", 0))
    h = {r.path.rsplit("/", 1)[-1][:-4]: r for r in files.wav_headers(spark, str(tmp_path)).collect()}
    assert {n: (h[n].subtype, h[n].frames, h[n].error) for n in made} == {n: (n, 5, None) for n in made}
    assert h["ADPCM"].error and h["ADPCM"].riff_status == "ok" and h["nofmt"].error
    for name in ("FLOAT", "DOUBLE", "PCM_U8", "PCM_24"):
        assert np.allclose(files.decode_wav(made[name])[0], x, atol=0.01)
    u, a = files.decode_wav(made["ULAW"])[0], files.decode_wav(made["ALAW"])[0]
    assert u[0] == 0 and abs(u[3] - 32124 / 32768) < 1e-6 and u[3] == -u[4] and abs(a[3] - 32256 / 32768) < 1e-6 and 0 < a[0] < 0.001 and a[0] == -a[4]


def test_headers_are_read_through_spark_where_arrow_has_no_file_system(spark, rows, corpus, monkeypatch):
    one = rows(files.wav_headers(spark, str(corpus)))
    listed = rows(files.listing_all(spark, str(corpus)))
    monkeypatch.setattr(files, "opens_directly", lambda root: False)
    assert rows(files.wav_headers(spark, str(corpus))) == one and rows(files.listing_all(spark, str(corpus))) == listed


def test_headers_and_riff(spark, corpus):
    h = {r.path.rsplit("/", 1)[-1]: r for r in files.wav_headers(spark, str(corpus)).collect()}
    assert len(h) == 5 and h["cut.wav"].riff_status == "truncated_RIFF" and h["TrainingM.wav"].riff_status == "ok"
    assert (h["TrainingM.wav"].sample_rate, h["TrainingM.wav"].frames, h["TrainingM.wav"].duration_s, h["TrainingM.wav"].subtype) == (8000, 8000, 1.0, "PCM_16")
    assert files.riff_status(b"abc", 3) == "non_RIFF_WAVE_requires_review"
    assert files.riff_status(b"RIFF" + struct.pack("<I", 12) + b"WAVEfmt " + struct.pack("<I", 0), 20) == "missing_data_chunk"
    assert files.riff_status(b"RIFF" + struct.pack("<I", 12) + b"WAVEdata" + struct.pack("<I", 99), 20) == "truncated_chunk"


def test_decode_and_crops(spark, corpus):
    x, rate = files.decode_wav(wav_bytes(0.5, channels=2, value=16384))
    assert rate == 8000 and len(x) == 4000 and np.allclose(x, 0.5)
    p = files.listing(spark, str(corpus), "TrainingM.wav").first().path
    jobs = spark.createDataFrame([(p, [(0.0, 0.25), (0.5, 1.5)])], "path string, intervals array<struct<s:double,e:double>>")
    c = files.crops(spark, str(corpus), jobs).orderBy("segment").collect()
    assert len(c[0].samples) == 2000 and c[0].error is None and c[1].error == "Invalid crop"
    w = spark.read.format("binaryFile").load(p).select(files.waveform("content").alias("w")).first().w
    assert len(w) == 8000


def test_label_documents_and_manifests(spark, rows, corpus):
    lab = readers.label_documents(spark, str(corpus)).cache()
    assert {r.file_ref.rsplit("/", 1)[-1]: r.issue for r in readers.label_issues(lab).collect()} == {"broken.json": "json_json", "shape.json": "json_no_utterances"}
    good = readers.readable(lab)
    assert good.count() == 5
    m = mf.manifests(files.real_files(files.listing(spark, str(corpus), "*.wav")), good)
    assert rows(m["gender"], "stem", "gender", "reporter_segments_ms", "num_segments")[0] == ("TrainingF", "F", "[[0,700],[500,1000]]", 2)
    assert m["speaker"].count() == 12 and "text" not in m["speaker"].columns
    assert rows(m["symptom"], "symptom_labels", "num_symptoms", "text")[0] == ("구토", 1, "말 0 말 1 말 2 말 3")
    seg = mf.audit_segments(good, files.wav_headers(spark, str(corpus)))
    assert seg.where("invalid").count() == 4 and seg.where("exceeds_wav").count() == 4
    pairs = spark.createDataFrame([("missing", None, "j"), ("a", "w", "j"), ("b", "w", None)], "stem string, wav_path string, json_path string")
    n = dict(mf.audit_issues(seg, pairs, readers.label_issues(lab)).groupBy("issue").count().collect())
    assert n == {"json_only": 1, "wav_only": 1, "json_json": 1, "json_no_utterances": 1, "invalid_segment_time": 4, "segment_exceeds_wav": 4}
    assert mf.gender_candidates(mf.label_table(good).withColumn("gender", F.lit("x"))).where("reason = 'no_gender'").count() == 5


def test_a_folder_a_file_makes_no_task_a_file(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i}").mkdir()
        (tmp_path / f"{i}/{i}.json").write_bytes(b"" if i % 20 == 0 else json.dumps(label(TIMES)).encode())
    lab, most = readers.label_documents(spark, str(tmp_path)), 3 * spark.sparkContext.defaultParallelism
    assert files.listing_all(spark, str(tmp_path)).rdd.getNumPartitions() <= most and lab.rdd.getNumPartitions() <= most
    assert {r.path.rsplit("/", 1)[-1]: r.error for r in lab.collect()} == {f"{i}.json": "json" if i % 20 == 0 else None for i in range(60)}


@pytest.mark.parametrize("glob", ["*.json", "*", "{a,z}.json", "[!a]*.json", "?.json"])
def test_contents_are_those_of_a_scan_and_empty_files(spark, rows, tmp_path, monkeypatch, glob):
    names = ["a.json", "b c%20.json", "_x.json", ".h.json", "_k=1.json", "_metadata.json", "q.json._COPYING_", "e.json", "._e.json", "d/a.json", "d/e/f/z.json", "_d/a.json", "_d=1/a.json", ".d/a.json", "x._COPYING_/a.json", "_metadata/z.json", "__MACOSX/e.json", "__MACOSX/z.json", "가/나.json", "d/n.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"" if n.endswith("e.json") else n.encode())
    monkeypatch.setattr(files, "READ_BYTES", 20)
    got = rows(files.contents(spark, str(tmp_path), glob))
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(str(tmp_path)).select("path", "content")
    assert [r for r in got if r[1]] == rows(scan) and [r[0].rsplit("/", 1)[-1] for r in got if not r[1]] == (["e.json"] if glob != "{a,z}.json" else [])
    monkeypatch.setattr(files, "opens_directly", lambda root: False)
    assert rows(files.contents(spark, str(tmp_path), glob)) == got and rows(files.contents(spark, str(tmp_path / "a.json"))) == [(f"file:{tmp_path}/a.json", b"a.json")]


def test_label_files_share_folders(spark):
    from callweave.queries.files import _label_files

    names = [r.path.rsplit("/", 2)[1:] for r in files.listing_all(spark, _label_files(spark, "/root/testdata/sf0.01")).collect()]
    assert len({n for _, n in names}) == len(names) == 297 and len({d for d, _ in names}) <= 256


def test_a_filter_on_the_error_parses_a_document_once(spark, tmp_path):
    odd = {"good": '{"utterances": []}', "null": "null", "list": "[]", "type": '{"utterances": [{"startAt": "x"}]}', "none": '{"utterances": null}', "bare": "{}", "blank": " "}
    for n, c in odd.items():
        (tmp_path / f"{n}.json").write_text(c)
    i = readers.label_issues(readers.label_documents(spark, str(tmp_path)))
    filters = [x for x in i._jdf.queryExecution().executedPlan().toString().split("\n") if "Filter" in x]
    assert filters and max(x.count("from_json(") for x in filters) <= 1
    assert {r.file_ref.rsplit("/", 1)[-1]: r.issue for r in i.collect()} == {f"{n}.json": "json_no_utterances" if n in ("none", "bare") else "json_json" for n in odd if n != "good"}


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b'{"utterances": [], "gender": "\xff\xfe"}')
    (tmp_path / "b.json").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[-1]: r.error for r in readers.label_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.json": "encoding", "b.json": "json"}


def test_zip_and_tar(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in ("d/a_20310101_1.json", "../b_20310101_2.json", "__MACOSX/c.json", "d/._e.json"):
            z.writestr(n, '{"k": "v"}')
    m = readers.zip_members(spark, str(tmp_path / "a.zip"))
    assert sorted(r.name for r in m.collect()) == ["a_20310101_1.json", "b_20310101_2.json"] and not (tmp_path.parent / "b_20310101_2.json").exists()
    assert readers.checked_members(m).count() == 2 and readers.member_audit(m).first().n == 2
    with pytest.raises(ContractError):
        readers.checked_members(m.union(m))
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for n in ("x.txt", "y.txt"):
            i = tarfile.TarInfo(n)
            i.size = 2
            t.addfile(i, io.BytesIO(b"hi"))
    assert [(r.member, bytes(r.content)) for r in readers.tar_members(spark, str(tmp_path / "a.tar.gz"), ["y.txt"]).collect()] == [("y.txt", b"hi")]


def test_torn_log(spark, rows, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"call_id": "a", "v": 1}\n{"call_id": "a", "v": 2}\n{"call_id":')
    assert rows(readers.jsonl_torn(spark, str(p), "call_id string, v int")) == [(0, "a", 1), (1, "a", 2)]
    with pytest.raises(ContractError):
        readers.jsonl_latest(spark, str(p), "call_id string, v int", "call_id")
    assert readers.repair_jsonl(str(p)) and not readers.repair_jsonl(str(p)) and (tmp_path / "log.jsonl.bak").exists()
    assert rows(readers.jsonl_latest(spark, str(p), "call_id string, v int", "call_id")) == [("a", 2)]
    p.write_text('{"call_id":\n{"call_id": "a", "v": 1}\n')
    with pytest.raises(ContractError, match="damaged"):
        readers.jsonl_torn(spark, str(p), "call_id string, v int")


def test_tables_and_npz(spark, rows, tmp_path):
    (tmp_path / "t.csv").write_text("﻿a,b\n1,x\n2,y\n", "utf-8")
    assert rows(readers.csv_table(spark, str(tmp_path / "t.csv"), "a int, b string", ["b"])) == [("x",), ("y",)]
    np.savez(tmp_path / "p.npz", ids=np.array(["a", "b"]), p=np.array([0.5, 0.25]))
    assert rows(readers.convert_npz(spark, [str(tmp_path / "p.npz")], "ids", {"p": "p"}, "id string, p double")) == [("a", 0.5), ("b", 0.25)]
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n')
    assert rows(readers.jsonl_table(spark, str(tmp_path / "r.jsonl"), "a int")) == [(1,)]


def test_sinks(spark, rows, tmp_path):
    d = spark.createDataFrame([(2, ["x", "y"]), (1, [])], "i int, s array<string>")
    sinks.write_csv(d, str(tmp_path / "c"), ["s", "i"], ["i"])
    assert [r.s for r in spark.read.csv(str(tmp_path / "c"), header=True).orderBy("i").collect()] == [None, "x;y"]
    with pytest.raises(Exception, match="already exists"):
        sinks.write_csv(d, str(tmp_path / "c"), ["i"])
    sinks.write_shards(spark.range(10).coalesce(1), str(tmp_path / "s"), 3)
    assert len(list((tmp_path / "s").glob("*.parquet"))) == 4
    sinks.write_by_prefix(spark.createDataFrame([("abc",), ("abd",), ("xyz",)], "k string"), str(tmp_path / "h"), "k")
    assert {p.name for p in (tmp_path / "h").glob("prefix=*")} == {"prefix=ab", "prefix=xy"}
    sinks.append_rows(d, str(tmp_path / "log"))
    sinks.append_rows(d, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    with pytest.raises(ValueError, match="NaN"):
        sinks.report(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "r.json"))
    assert sinks.report(spark.range(1), str(tmp_path / "r.json")) == {"rows": [{"id": 0}]} == json.loads((tmp_path / "r.json").read_text())
    with pytest.raises(FileExistsError):
        sinks.empty_folder(str(tmp_path))
    sinks.empty_folder(str(tmp_path / "new"))
    assert list(sinks.bundle([str(tmp_path / "r.json")], str(tmp_path / "b.zip"))) == ["r.json"]
    sinks.write_predictions(d, str(tmp_path / "p"))


def test_resume_repeats_what_failed_only(spark, rows, tmp_path):
    jobs, seen, path = spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), [], str(tmp_path / "state")

    def work(fails, lost=()):
        def run(t):
            seen.append(sorted(r.k for r in t.collect()))
            err = F.when(F.col("k").isin(*fails, ""), "broke")
            return t.where(~F.col("k").isin(*lost, "")).select("k", F.length("k").alias("v"), err.alias("error"))

        return run

    assert inc.run_pending(jobs, "k", work(["b"], ["c"]), path, "one") == 1
    assert rows(inc.committed(spark, path)) == [("a", 1)]
    assert rows(inc.committed(spark, path, "quality")) == [("a", "done", None), ("b", "failed", "broke"), ("c", "failed", "no result")]

    def breaks(t):
        raise RuntimeError("driver lost")

    with pytest.raises(RuntimeError):
        inc.run_pending(jobs, "k", breaks, path, "one")
    assert rows(inc.committed(spark, path)) == [("a", 1)]
    assert inc.run_pending(jobs, "k", work([]), path, "one") == 2 and seen == [["a", "b", "c"], ["b", "c"]]
    assert rows(inc.committed(spark, path)) == [("a", 1), ("b", 1), ("c", 1)] and inc.check_cursor(spark, path, "one")["done"] == 2
    with pytest.raises(ContractError):
        inc.run_pending(jobs, "k", work([]), path, "another")
    with pytest.raises(ContractError, match="no job"):
        inc.run_pending(jobs.where("k = 'a'"), "k", work([]), path, "one")
    assert inc.unresolved_failures(jobs, inc.committed(spark, path).where("k = 'a'"), "k").count() == 2


def test_keys_have_to_be_known_and_single(spark):
    j = spark.createDataFrame([("a",), ("b",)], "k string")
    assert inc.pending(j, None, "k").count() == 2 and inc.pending(j, j.limit(1), "k").count() == 1
    for jobs, done in ((j, j.union(j)), (j, spark.createDataFrame([("x",)], "k string")), (j.union(j), None)):
        with pytest.raises(ContractError):
            inc.pending(jobs, done, "k")


def test_one_writer_and_gates(spark, tmp_path):
    path = str(tmp_path / "w")
    with inc.single_writer(spark, path):
        with pytest.raises(ContractError, match="another writer"), inc.single_writer(spark, path):
            pass
    with inc.single_writer(spark, path):
        pass
    with pytest.raises(ContractError):
        inc.need_gate(spark, path, "bench")
    with pytest.raises(ContractError, match="too slow"):
        inc.pass_gate(spark, path, "bench", "too slow")
    inc.pass_gate(spark, path, "bench", None)
    inc.need_gate(spark, path, "bench")


def test_stream_sink_is_idempotent_and_resumes(spark, rows, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()

    def run():
        s = spark.readStream.schema("k string, v int").json(str(src))
        q = s.writeStream.foreachBatch(inc.upsert_batch(out, "k")).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()

    (src / "1.json").write_text('{"k": "a", "v": 1}\n{"k": "a", "v": 1}\n')
    run()
    (src / "2.json").write_text('{"k": "a", "v": 9}\n{"k": "b", "v": 2}\n')
    run()
    run()
    assert rows(spark.read.parquet(out), "k", "v") == [("a", 1), ("b", 2)]
    # a batch that is played again changes nothing, and looks only through the buckets of its own keys
    inc.upsert_batch(out, "k")(spark.createDataFrame([("a", 9), ("b", 2)], "k string, v int"), 1)
    assert rows(spark.read.parquet(out), "k", "v") == [("a", 1), ("b", 2)]


def test_streamed_union_equals_batch(spark, rows, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"k": "u", "ts": f"2031-01-01T00:00:{s:02d}Z", "ms": n}) for s, n in ((0, 2000), (1, 2000), (3, 1000), (10, 500))))
    schema = "k string, ts timestamp, ms bigint"
    batch = inc.merged_sessions(spark.read.schema(schema).json(str(src)), "k", "ts", F.col("ms"))
    assert [r.n for r in batch.orderBy("period_start").collect()] == [3, 1]
    stream = inc.merged_sessions(spark.readStream.schema(schema).json(str(src)), "k", "ts", F.col("ms"), "1 minute")
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("sessions")) == rows(batch)


def test_once_each_stream_status_eta(spark, rows, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "1.json").write_text('{"k": "a", "ts": "2031-01-01T00:00:00Z"}\n{"k": "a", "ts": "2031-01-01T00:00:01Z"}\n')
    s = inc.once_each(spark.readStream.schema("k string, ts timestamp").json(str(src)), "k", "ts", "1 hour")
    q = s.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 1
    d = spark.createDataFrame([(1, 2.0, 10.0), (1, 4.0, 20.0), (0, None, 60.0)], "status int, s double, audio double")
    assert rows(inc.status_summary(d)) == [(1, 2, 0, 3)]
    assert rows(inc.eta(d, F.col("status") == 1, "s", ["audio"])) == [(3.0, 12.0)]
