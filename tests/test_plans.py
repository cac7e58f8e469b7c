import json
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.operators.checks import ContractError
from callweave.plans import features, splits, texts
from callweave.sources import files


def write_tone(path, hz, seconds=1.2, rate=8000):
    t = np.arange(int(seconds * rate)) / rate
    x = 0.3 * sum(np.sin(2 * np.pi * hz * k * t) / k for k in (1, 2, 3))
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(struct.pack(f"<{len(x)}h", *(x * 20000).astype(int)))


def test_recordings_to_accuracy(spark, tmp_path):
    for i in range(12):
        write_tone(tmp_path / f"{i:02d}.wav", (110 if i % 2 else 220) + i)
    f = files.listing(spark, str(tmp_path), "*.wav")
    iv = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0.5).alias("e")), F.struct(F.lit(0.6).alias("s"), F.lit(1.1).alias("e")), F.struct(F.lit(1.0).alias("s"), F.lit(9.0).alias("e")))
    seg = features.segment_features(spark, str(tmp_path), f.select("path", iv.alias("intervals"))).cache()
    assert seg.count() == 24 and seg.where("reliable = 1").count() == 24
    c = features.call_features(seg)
    n = F.regexp_extract("path", r"(\d+)\.wav", 1).cast("int")
    c = c.withColumn("y", n % 2).withColumn("partition", F.when(n < 8, "train").otherwise("val"))
    pred, acc = features.fit_and_report(c, "path", "y", "partition")
    assert acc.first().accuracy == 1.0 and pred.count() == 4


def test_frozen_split_and_its_errors(spark):
    rows = [(f"id{i:03d}", "MF"[i % 2], f"w{i}", 3, 10.0 + i) for i in range(100)]
    d = spark.createDataFrame([*rows, ("bad", "x", "w", 3, 1.0), ("nan", "M", "w", 3, float("nan"))], "call_id string, gender string, wav string, n_segments int, total_duration double")
    e = splits.eligible(d)
    s = splits.frozen_split(e).cache()
    assert e.count() == 100 and s.where("partition = 'internal_validation'").count() == 20
    splits.no_leakage(s, ["call_id", "wav"])
    with pytest.raises(ContractError, match="same leaks 1"):
        splits.no_leakage(s.withColumn("same", F.lit(1)), ["wav", "same"])
    with pytest.raises(ContractError, match="Duplicate"):
        splits.frozen_split(e.union(e.limit(1)))
    with pytest.raises(ContractError, match="Conflicting"):
        splits.frozen_split(e.union(e.limit(1).withColumn("gender", F.when(F.col("gender") == "M", "F").otherwise("M"))))
    r = {x.measure: x.value for x in splits.split_report(s).collect()}
    assert r["n_train"] == 80 and r["share_F_train"] == 0.5 and r["majority_accuracy"] == 0.5 and abs(r["smd_duration"]) < 1 and r["max_bin_gap_pp"] < 30


def test_texts_to_thresholds(spark):
    docs = []
    for i in range(40):
        word = "토할 것 같아요" if i % 2 else "머리가 아파요"
        docs.append((f"s{i:02d}", [(str(i), 0, 1, word, 1), ("z", 2, 3, f"번지 {i}", 0)], ["구토" if i % 2 else "두통", "기타"]))
    d = spark.createDataFrame(docs, "stem string, utterances array<struct<id:string,startAt:bigint,endAt:bigint,text:string,speaker:int>>, symptom array<string>")
    rows = texts.training_rows(d, ["구토", "두통"])
    assert rows.columns == ["stem", "text", "구토", "두통"] and json.dumps(rows.first().asDict())
    p = texts.tag(rows, "stem", "text", ["구토", "두통"], F.col("stem") < "s30", 10.0, lo=2, hi=3)
    t = texts.tuned(p).collect()
    assert p.count() == 20 and {r.f1 for r in t} == {1.0}
