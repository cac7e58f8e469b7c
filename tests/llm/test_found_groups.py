import datetime as dt

from callweave.llm import splits


def test_found_groups_come_from_the_component_table(spark, rows, tmp_path, monkeypatch):
    from callweave.llm.all import QUERIES

    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    calls = [(f"m{i}", "F", f"w{i}_x.wav", None, at(i), "train") for i in range(20)]
    # the last batch merges two components of the first under a record with the least name
    calls += [("a0", "M", "w1_y.wav", "c0000000a", at(30), "test"), ("b0", "M", "w2_y.wav", "c0000000a", at(31), "train"), ("z0", "F", "w5_z.wav", None, at(32), "train"), (None, "F", "w5_q.wav", None, at(3), "test")]
    df = spark.createDataFrame(calls, "call_id string, gender string, wav_relative_path string, caller_ref string, loaded_at timestamp, partition string")
    df.write.parquet(f"{tmp_path}/calls.parquet")
    batches, assign = [], splits.assign_splits
    monkeypatch.setattr(splits, "assign_splits", lambda *a: (batches.append(a[0]), assign(*a))[1])
    got = rows(QUERIES["p2_found"](spark, str(tmp_path)), "call_id", "group_id")
    assert got == [(x, "a0") for x in ("a0", "b0", "m1", "m2")]
    assert [b is None for b in batches] == [True, False, False]
