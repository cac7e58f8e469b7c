import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.functions import audio, scalar, udfs
from callweave.operators import checks, evaluate, ml, pairing, sampling, signals, stats, text


def test_pairing_last_path_wins_and_census(spark, rows):
    a = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "3")], "stem string, wav string")
    b = spark.createDataFrame([("x", "j"), ("z", "k")], "stem string, json string")
    p = pairing.pair_by_key(a, b, "stem", "wav", "json")
    assert rows(p) == [("x", "2", "j"), ("y", "3", None), ("z", None, "k")]
    assert rows(pairing.pair_census(p, "wav", "json")) == [(1, 1, 1, 3)]
    assert rows(pairing.multiplicity(a, b, "stem"), "stem", "state") == [("x", "ambiguous"), ("y", "left_only"), ("z", "right_only")]
    assert pairing.unique_pairs(a, b, "stem").count() == 0


def test_ordered_join_keeps_positions(spark, rows):
    m = spark.createDataFrame([(0, "2"), (1, "0"), (2, "1")], "position int, k string")
    s = spark.createDataFrame([("0", "dev"), ("1", "dev"), ("2", "train")], "k string, split string")
    assert [r.k for r in pairing.ordered_left_join(m, s, "k", "position").where("split = 'dev'").orderBy("position").collect()] == ["0", "1"]


def test_checked_join_rejects_repeats_and_gaps(spark):
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    b = spark.createDataFrame([("x", 1), ("x", 2)], "k string, v int")
    with pytest.raises(checks.ContractError, match="not unique"):
        checks.checked_join(a, b, "k")
    with pytest.raises(checks.ContractError, match="cover"):
        checks.checked_join(a, b.limit(1), "k", complete=True)
    assert checks.checked_join(a, b, "k", "left", "one_to_many").count() == 3


def test_duplicates_differ_from_conflicts(spark, rows):
    d = spark.createDataFrame([("a", "M"), ("a", "M"), ("b", "M"), ("b", None), ("c", "F")], "k string, g string")
    assert rows(checks.key_report(d, "k", "g"), "k", "status") == [("a", "duplicate"), ("b", "conflict")]


def test_leakage_and_coverage(spark, rows):
    d = spark.createDataFrame([("p1", "q1", "train"), ("p1", "q2", "test"), (None, "q3", "test")], "path string, ref string, part string")
    assert rows(checks.leakage(d, ["path", "ref"], "part")) == [("path", 1, 1), ("ref", 3, 0)]
    a, b = spark.createDataFrame([("1",), ("2",)], "k string"), spark.createDataFrame([("2",), ("3",)], "k string")
    assert rows(checks.coverage(a, b, "k")) == [("1", "right"), ("3", "left")]


def test_reconcile_and_misaligned(spark, rows):
    p = spark.createDataFrame([("a", 3), ("b", 1), ("c", 0)], "k string, n int")
    c = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, x double")
    assert rows(checks.reconcile(p, c, "k", [("n", F.count(F.lit(1)))]), "k") == [("a",), ("b",)]
    assert rows(checks.misaligned(p, p.withColumn("n", F.col("n") + (F.col("k") == "b").cast("int")), "k", ["n"])) == [("b",)]


@pytest.mark.parametrize("p,q,pred,fault", [(0.2, 0.8, "M", None), (math.nan, 0.5, "M", "not_finite"), (1.2, -0.2, "F", "out_of_range"), (0.5, 0.4, "F", "sum"), (0.2, 0.8, "F", "argmax"), (0.5, 0.5, "F", None), (None, 0.5, "M", "not_finite")])
def test_prediction_faults_one_at_a_time(spark, p, q, pred, fault):
    d = spark.createDataFrame([(p, q, pred)], "p double, q double, pred string")
    assert [r.fault for r in checks.prediction_faults(d, ["p", "q"], "pred", ["F", "M"]).collect()] == ([fault] if fault else [])


def test_vectors_identity_metrics(spark, rows):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, math.nan]), (4, None)], "i int, v array<double>")
    assert rows(checks.vector_faults(v, "v", 2), "i") == [(2,), (3,), (4,)]
    with pytest.raises(checks.ContractError):
        checks.same_identity(checks.identity(v, {"a": "1"}), checks.identity(v, {"a": "2"}))
    m = spark.createDataFrame([("acc", 0.5), ("f1", 0.1)], "metric string, value double")
    assert rows(checks.metric_gaps(m, m.withColumn("value", F.when(F.col("metric") == "f1", 0.2).otherwise(F.col("value")))), "metric") == [("f1",)]


def test_sets_logs_and_copies(spark, rows):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(pairing.key_union(a, b, "k")) == [(1,), (2,), (3,)] and rows(pairing.shared_values(a, b, "k")) == [(2,)]
    assert rows(pairing.key_difference(a, b, "k")) == [(1,)] and not pairing.same_sets(a, b, "k") and pairing.same_sets(a, a, "k")
    old, new = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string"), spark.createDataFrame([(2, "Y")], "k int, v string")
    assert rows(pairing.migrate_log(old, new, a, "k")) == [(1, "x")] and rows(pairing.log_conflicts(old, new, "k")) == [(2,)]
    x = spark.createDataFrame([("n", "h1"), ("m", "h2"), ("o", "h3")], "name string, sha256 string")
    y = spark.createDataFrame([("n", "h1"), ("m", "h9"), ("q", "h4")], "name string, sha256 string")
    assert rows(pairing.resolve(x, y, ["name"])) == [("m", "different"), ("n", "same"), ("o", "local_only"), ("q", "archive_only")]
    f = pairing.consistent_features([x.withColumn("n", F.lit(1)), x.withColumn("n", F.when(F.col("name") == "m", 2).otherwise(1))], "name", ["sha256", "n"])
    assert rows(f.where("mismatch is not null"), "name", "mismatch") == [("m", "n")]


def test_statistics_match_numpy(spark):
    x = [1.0, 2.5, math.nan, 7.0, math.inf, 11.0, 3.25]
    r = stats.stats(spark.createDataFrame([(v,) for v in x], "x double"), [], "x").first()
    y = np.array([v for v in x if math.isfinite(v)])
    assert r["n"] == 5 and np.allclose([r[c] for c in ("mean", "min", "max", "q25", "median", "q75", "q90", "q95")], [y.mean(), y.min(), y.max(), *np.percentile(y, [25, 50, 75, 90, 95])])
    assert stats.stats(spark.createDataFrame([], "x double"), [], "x").first()["n"] == 0


def test_exact_quantiles_match_numpy(spark):
    r = np.random.default_rng(5)
    x = {"a": r.normal(size=3000), "b": np.round(r.random(700), 1), None: np.array([4.0]), "hot": np.full(2000, 7.0)}
    d = spark.createDataFrame([(k, float(v)) for k, a in x.items() for v in a] + [("a", math.nan), ("b", None)], "k string, x double")
    p = [0.0, 0.25, 0.5, 0.9, 0.95, 1.0]
    got = {(q.k, q.p): q.quantile for q in stats.exact_quantiles(d, ["k"], "x", p, cells=16).collect()}
    assert len(got) == 24 and all(got[k, q] == pytest.approx(np.quantile(a, q), abs=1e-12) for k, a in x.items() for q in p)
    one = stats.exact_quantiles(d.where("k = 'a'").select("x"), [], "x", [0.5]).first()
    assert one.quantile == pytest.approx(np.quantile(x["a"], 0.5))
    assert stats.exact_quantiles(d.limit(0), ["k"], "x", p).count() == 0


def test_difference_gap_majority(spark):
    d = spark.createDataFrame([("t", 1.0, "F"), ("t", 3.0, "M"), ("v", 2.0, "M"), ("v", 6.0, "M")], "p string, x double, g string")
    assert stats.standardized_difference(d, "p", "t", "v", "x").first()[0] == pytest.approx(2 / math.sqrt((2 + 8) / 2))
    assert stats.standardized_difference(d.withColumn("x", F.lit(1.0)), "p", "t", "v", "x").first()[0] == 0
    assert stats.bin_gap(d, "p", "t", "v", scalar.bin_label(F.col("x"), [0, 2, 5])).first()[0] == pytest.approx(50)
    m = stats.majority_baseline(d, "p", "t", "v", "g").first()
    assert m["majority"] == "M" and m["accuracy"] == 1.0


def test_cohorts_empty_groups_weights(spark, rows):
    d = spark.createDataFrame([("a", True, 1), ("b", False, 5), ("a", False, 9)], "g string, wrong boolean, n int")
    assert rows(stats.cohorts(d, {"small": F.col("n") < 6, "large": F.col("n") > 4}, F.col("wrong"))) == [("large", 2, 0, 0.0, 0.0), ("small", 2, 1, 0.5, 1.0)]
    groups = spark.createDataFrame([("a",), ("z",)], "g string")
    assert rows(stats.group_metric(d, "g", groups, ~F.col("wrong"))) == [("a", 2, 0.5), ("z", 0, None)]
    w = spark.createDataFrame([(1, 0)] * 4149 + [(0, 0)] * 19259, "y int, z int")
    got = dict(stats.class_weights(w, ["y", "z"]).collect())
    assert got["y"] == pytest.approx(2.1545, abs=1e-4) and got["z"] == 3.0


def test_staged_duplicates_and_issue_counts(spark, rows):
    d = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "abd"), (4, "x"), (5, None)], "id int, t string").withColumn("n", F.length("t"))
    assert rows(stats.staged_duplicates(d, "id", "n", scalar.edge_hash(F.col("t"), 2), F.sha2("t", 256)), "id") == [(1,), (2,)]
    i = spark.createDataFrame([("s", "x"), ("s", "x"), ("t", "y")], "split string, issue string")
    assert rows(stats.issue_counts(i)) == [("all", "x", 2), ("all", "y", 1), ("s", "x", 2), ("t", "y", 1)]


def test_vectors_and_weighted_means(spark, rows):
    d = spark.createDataFrame([("a", [1.0, 1.0]), ("a", [3.0, 3.0])], "k string, v array<float>")
    assert rows(stats.mean_vector(d, "k", "v")) == [("a", 0, 2.0), ("a", 1, 2.0)]
    w = spark.createDataFrame([("a", 1.0, 1.0), ("a", 4.0, 3.0), ("b", 1.0, 0.0)], "k string, x double, w double")
    assert rows(stats.weighted_mean(w, ["k"], "x", "w")) == [("a", 3.25), ("b", None)]


def test_grids_are_those_of_arange():
    assert evaluate.F1_GRID == np.arange(0.05, 0.96, 0.01).tolist() and len(evaluate.F1_GRID) == 91
    assert evaluate.ACCURACY_GRID == np.arange(0.2, 0.8001, 0.005).tolist()[:121]


def test_sweeps_match_brute_force(spark):
    r = np.random.default_rng(1)
    y, p = r.integers(0, 2, 200), np.round(r.random(200), 2)
    d = spark.createDataFrame([("l", int(a), float(b)) for a, b in zip(y, p)], "label string, y int, p double")
    t = np.array(evaluate.F1_GRID)

    def f1(x):
        d = p >= x
        tp, fp, fn = (d & (y == 1)).sum(), (d & (y == 0)).sum(), (~d & (y == 1)).sum()
        return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0

    best = evaluate.sweep_f1(d, ["label"], "y", "p").first()
    scores = [f1(x) for x in t]
    assert best["threshold"] == t[int(np.argmax(scores))] and best["f1"] == pytest.approx(max(scores))
    acc = evaluate.sweep_accuracy(d, "y", "p").first()
    a = np.array([((p >= x) == (y == 1)).mean() for x in evaluate.ACCURACY_GRID])
    assert acc["accuracy"] == pytest.approx(a.max())
    n = d.select(F.col("p"), evaluate.reached(F.col("p"), evaluate.F1_GRID).alias("k")).collect()
    assert all(k == (t <= x).sum() for x, k in n)


def test_perfect_prediction_overlap_confusion(spark, rows):
    d = spark.createDataFrame([("l1", 1, 1), ("l1", 0, 0), ("l2", 1, 1)], "label string, y int, d int")
    assert evaluate.macro_f1(evaluate.precision_recall(d, "label", "y", "d")).first()[0] == 1.0
    o = spark.createDataFrame([("M", "F", "F"), ("M", "M", "F"), ("M", "F", "M"), ("F", "M", "M"), ("M", "F", "M")], "t string, old string, new string")
    assert rows(evaluate.model_overlap(o.limit(4), "t", "old", "new")) == [(0, 1, 1, 2)]
    assert rows(evaluate.all_wrong(o, "t", ["old", "new"], "old")) == [(2, 2)]
    assert rows(evaluate.confusion(o, "t", "old", ["F", "M"])) == [("F", 0, 1), ("M", 3, 1)]


def test_hash_split_is_stable_and_stratified(spark, rows):
    import hashlib

    ids = [(hashlib.sha256(f"{g}{i}".encode()).hexdigest(), g) for g in "MF" for i in range(10)]
    d = spark.createDataFrame(ids, "call_id string, gender string")
    a = rows(sampling.hash_split(d, "gender", "call_id"), "call_id", "gender", "partition")
    b = rows(sampling.hash_split(spark.createDataFrame(ids[::-1], d.schema).repartition(3), "gender", "call_id"), "call_id", "gender", "partition")
    assert a == b != rows(sampling.hash_split(d, "gender", "call_id", seed="43"), "call_id", "gender", "partition")
    held = [r for r in a if r[2] == "internal_validation"]
    want = {g: sorted((x for x, y in ids if y == g), key=lambda x: hashlib.sha256(b"42\0" + g.encode() + b"\0" + x.encode()).hexdigest())[:2] for g in "MF"}
    assert sorted(r[0] for r in held) == sorted(want["M"] + want["F"])
    f = sampling.folds(d, "gender", "call_id", 3).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in f) == [6, 6, 8]


def test_quartiles_and_places(spark, rows):
    d = spark.createDataFrame([("g", v, f"i{v}") for v in range(6)], "g string, v bigint, id string")
    assert [r.quartile for r in sampling.quartiles(d, ["g"], "v", ["id"]).orderBy("v").collect()] == [0, 0, 1, 2, 3, 3]
    assert rows(sampling.smoke_rows(d, ["g"], "v", "id"), "v") == [(0,), (3,), (5,)]
    assert rows(sampling.representatives(d, ["g"], "v", "id", 2), "v") == [(1,), (4,)]
    e = spark.createDataFrame([("g", 1, 5, "a"), ("g", 1, 5, "b")], "g string, lo int, hi int, id string")
    assert rows(sampling.extremes(e, ["g"], "lo", "hi", "id")) == [("g", "a", "b")]
    s = sampling.stratified_sample(d, ["g"], "id", 2)
    assert s.count() == 2 and {r.stratum_size for r in s.collect()} == {6}


@pytest.mark.parametrize("n", [1, 47_999, 48_000, 240_000, 240_001, 480_001])
def test_balanced_parts(spark, n):
    parts = spark.range(1).select(sampling.balanced_parts(F.lit(n), 240_000).alias("p")).first()[0]
    assert sum(parts) == n and max(parts) - min(parts) <= 1 and max(parts) <= 240_000 and len(parts) == math.ceil(n / 240_000)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_scalars(spark):
    assert one(spark, scalar.squeeze(F.lit("토할 　 것 같아요.\n토는 안 했어요. "))) == "토할 것 같아요. 토는 안 했어요."
    assert one(spark, scalar.sample_index(F.lit(62.5), 8)) == 0 and one(spark, scalar.sample_index(F.lit(187.5), 8)) == 2
    assert one(spark, scalar.safe_ratio(F.lit(1), F.lit(0))) == 0 and one(spark, scalar.safe_ratio(F.lit(1), F.lit(0), None)) is None
    assert one(spark, scalar.guess_role(F.lit("알겠습니다 아파요"))) == "dispatcher" and one(spark, scalar.guess_role(F.lit("음"))) is None
    assert one(spark, scalar.safe_path(F.lit("a/../b"))) is False and one(spark, scalar.safe_path(F.lit("/a"))) is False and one(spark, scalar.safe_path(F.lit("a/b.wav")))
    assert one(spark, scalar.file_stem(F.lit("x\\y/z.tar.wav"))) == "z.tar" and one(spark, scalar.parent_name(F.lit("a/b/c"))) == "b"
    assert one(spark, F.size(scalar.head_tail(F.sequence(F.lit(0), F.lit(509))))) == 510
    t = one(spark, scalar.head_tail(F.sequence(F.lit(0), F.lit(599))))
    assert t == [*range(255), *range(345, 600)]
    assert one(spark, scalar.join_token_lists(F.array(F.array(F.lit(1)), F.array(F.lit(2), F.lit(3))), F.lit(0))) == [1, 0, 2, 3]
    assert one(spark, scalar.bin_label(F.lit(1), [0, 1, 2])) == "[1,2)" and one(spark, scalar.bin_label(F.lit(-1), [0, 1])) is None
    assert one(spark, scalar.pick_of_two(F.array(F.lit(0.5), F.lit(0.5)))) == "F"
    assert one(spark, scalar.resampled_samples(F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0.25).alias("e")), F.struct(F.lit(0.5).alias("s"), F.lit(1.0).alias("e"))))) == 12_000
    import hashlib

    assert one(spark, scalar.salted_hash("42", F.lit("M"), F.lit("x"))) == hashlib.sha256(b"42\0M\0x").hexdigest()
    assert one(spark, scalar.nfc(F.lit("한"))) == "한"


def test_text_projections(spark, rows):
    d = spark.createDataFrame([("c", 2, "b"), ("c", 1, None), ("c", 3, "d")], "k string, o int, t string")
    assert rows(text.call_text(d, "k", ["o"], "t")) == [("c", " b d")]
    lab = spark.createDataFrame([("c", ["구토", "오심", "기타", "구토"]), ("e", None)], "k string, s array<string>")
    assert rows(text.multi_hot(lab, "s", ["구토", "오심", "열상"], ["k"])) == [("c", 1, 1, 0), ("e", 0, 0, 0)]
    assert one(spark, text.kept_labels(F.array(F.lit("두통"), F.lit("복통"), F.lit("찰과상")), scalar.SYMPTOMS)) == ["두통", "복통"]
    assert one(spark, text.char_ngrams(F.lit("abc"), 2, 4)) == ["ab", "bc", "abc"] and one(spark, text.char_ngrams(F.lit(""), 2, 3)) == []
    with pytest.raises(Exception):
        text.only_columns(d, ["nope"]).collect()
    assert text.only_columns(d, ["k"]).columns == ["k"]


def test_signals_match_numpy(spark):
    a = F.array(*[F.lit(float(i)) for i in range(10)])
    assert one(spark, signals.crop(a, F.lit(3), F.lit(6))) == [3, 4, 5] and one(spark, signals.crop(a, F.lit(8), F.lit(3))) == []
    assert one(spark, signals.pad_or_trim(a, 12, "center")) == [0, *range(10), 0] and one(spark, signals.pad_or_trim(a, 4, "start")) == [6, 7, 8, 9]
    assert one(spark, signals.window_starts(F.lit(10), 4, 4)) == [0, 4, 8] and one(spark, signals.window_starts(F.lit(10), 4, 4, True)) == [0, 4]
    assert one(spark, signals.windows(a, 4, 4))[-1] == [8, 9, 0, 0] and one(spark, signals.window_starts(F.lit(3), 4, 4, True)) == []
    assert one(spark, signals.frame_starts(F.lit(100), 200, 80)) == [0]
    assert np.allclose(one(spark, signals.pre_emphasis(a)), np.r_[0, np.arange(1, 10) - 0.97 * np.arange(9)])
    assert np.allclose(one(spark, signals.pooled(a, 4)), audio.pool(np.arange(10.0)[None], 4)[0])


def tone(hz, seconds=1.0, rate=8000):
    return 0.3 * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


@pytest.mark.parametrize("hz", [110, 180, 220])
def test_pitch_of_tones(hz):
    s = audio.acoustic_summary(tone(hz))
    assert abs(s["f0_median"] - hz) < 3 and s["reliable"] == 1


def test_pitch_limits_and_silence():
    assert abs(np.nanmedian(audio.pitch_track(tone(660))) - 660) < 5 and audio.acoustic_summary(tone(660))["reliable"] == 0
    assert np.isnan(audio.acoustic_summary(np.zeros(8000))["f0_mean"]) and audio.level_quality(np.zeros(8000))["silence_ratio"] == 1


def test_cepstra_views_resampling():
    m = audio.mfcc_summary(tone(180))
    assert m.shape == (26,) and np.isfinite(m).all() and np.isfinite(audio.mfcc_summary(tone(180, 0.01))).all()
    c = audio.cosines(26, 26)
    assert np.allclose(c @ c.T, np.eye(26))
    assert audio.two_views(tone(180, 0.3)).shape == (64, 48) and audio.two_views(tone(180)).dtype == np.uint8
    up = audio.resample_up(tone(200))
    assert len(up) == 16_000 and np.abs(up[400:-400] - tone(200, rate=16_000)[400:-400]).max() < 1e-3
    assert np.array_equal(audio.masked_mean([[1, 2], [3, 4], [100, 200]], [1, 1, 0]), [2, 3])
    assert audio.crop_strict(np.arange(80), 0.002, 0.006, 8000).tolist() == list(range(16, 48))
    with pytest.raises(ValueError, match="Invalid crop"):
        audio.crop_strict(np.arange(80), -0.1, 0.005, 8000)
    assert audio.band_shares(tone(300)).argmax() == 1


def test_json_helpers(spark, rows):
    doc = {"a": [{"b": 1}, {"b": "x"}], "e": [], "n": {"address": "서울시 가"}, "u": [{"text": "t"}]}
    assert list(udfs.walk(doc)) == [("a[].b", "integer", "1"), ("a[].b", "string", "x"), ("e", "array", None), ("n.address", "string", "서울시 가"), ("u[].text", "string", "t")]
    assert next(udfs.walk(doc, inner=True)) == ("$", "object", None)
    assert udfs.find_key(doc, ["address"]) == "서울시 가" and udfs.find_string(doc, "서울") == "서울시 가" and udfs.find_records(doc, "text") == [{"text": "t"}]
    assert udfs.redact({"k": "v", "z": [1, 2, 3, 4]}, frozenset({"k"})) == {"k": "v", "z": ["<int:redacted>"] * 3}
    d = spark.createDataFrame([("1", '{"address": "부산"}'), ("2", '{"x": {"addr": "서울"}}'), ("3", "no json"), ("4", None)], "i string, t string")
    assert rows(d.select("i", udfs.resolved_address(F.col("t")).alias("a"))) == [("1", "부산"), ("2", "서울"), ("3", None), ("4", None)]
    assert rows(udfs.walked(d, "i", "t"), "id", "type")[2:] == [("3", "invalid"), ("4", "invalid")]


def test_scaler_sees_training_rows_only(spark, rows):
    d = spark.createDataFrame([(1, 0.0, "t"), (2, 1.0, "t"), (3, None, "t"), (4, 1e6, "v"), (5, math.nan, "v")], "i int, x double, p string")
    s = ml.train_statistics(d, ["x"], F.col("p") == "t").first()
    assert s["x_median"] == 0.5 and s["x_mean"] == 0.5 and s["x_std"] == pytest.approx(np.std([0, 1, 0.5]))
    out = {r.i: r.x for r in ml.impute_scale(d, ["x"], F.col("p") == "t").collect()}
    assert out[3] == 0 and out[5] == 0 and out[4] > 1e5


def test_folds_leakage_and_projection(spark):
    d = spark.createDataFrame([("a", 0), ("a", 1)], "id string, fold int")
    with pytest.raises(checks.ContractError, match="leakage"):
        ml.cross_validate(d, "fold", "id", lambda t: None, lambda m, t: t)
    ok = spark.createDataFrame([("a", 0), ("b", 1)], "id string, fold int")
    assert ml.cross_validate(ok, "fold", "id", lambda t: None, lambda m, t: t, done=[0]).count() == 1
    assert ml.quadratic_projection(0.64, 5000, 22388) == pytest.approx(12.83, abs=0.01)
    assert ml.realtime_projection(83.46, 655.8, 937_000)[1] is False


def test_logistic_separates(spark):
    d = spark.createDataFrame([(float(i % 2), [float(i % 2) + 0.01 * i, 1.0]) for i in range(40)], "y double, v array<double>")
    m = ml.logistic(ml.as_vector(d, "v"), "y", 10.0)
    p = ml.probability(m, ml.as_vector(d, "v"))
    assert p.where("(p >= 0.5) <> (y = 1)").count() == 0


def test_pitch_follows_the_cheapest_path():
    """A voice whose second harmonic is at times the stronger one does not jump an octave; noise is unvoiced."""
    t = np.arange(8000) / 8000
    x = 0.2 * np.sin(2 * np.pi * 120 * t) + 0.2 * np.sin(2 * np.pi * 240 * t) * (1 + np.sin(2 * np.pi * 3 * t)) + 0.1 * np.sin(2 * np.pi * 360 * t)
    f = audio.pitch_track(x)
    assert len(f) == (8000 - 480) // 80 + 1 and (f > 0).mean() > 0.95 and abs(f[f > 0] - 120).max() < 4
    noise = audio.pitch_track(np.random.default_rng(0).normal(0, 0.1, 8000))
    assert (noise > 0).mean() < 0.3 and not audio.pitch_track(np.zeros(8000)).any() and len(audio.pitch_track(np.ones(100))) == 0
    half = audio.pitch_track(np.concatenate([tone(180), np.zeros(8000)]))
    assert (half[:90] > 0).all() and not (half[105:] > 0).any()


def test_decibel_cepstra_have_the_usual_defaults():
    x = tone(440, 1.0, 22050)
    m = audio.mfcc_db(x)
    assert m.shape == (20, 1 + 22050 // 512) and audio.mel_power(x).shape[0] == 128
    # a stationary tone: the orthonormal transform of the decibel spectrum, which can be turned back
    db = 10 * np.log10(np.maximum(audio.mel_power(x), 1e-10))
    full = audio.cosines(128, 128)
    assert np.allclose(full[:20] @ np.maximum(db, db.max() - 80), m)
    assert audio.mfcc_db(x, 8000, 13, 40, 512, 160, center=False).shape == (13, 1 + (len(x) - 512) // 160)


def test_chosen_windows_are_stable_and_bounded():
    seg = [(0.0, 0.4), (1.0, 9.0), (2.0, 2.6), (3.0, 3.5), (5.0, 5.9), (20.0, 30.0)]
    w = audio.choose_windows(seg, 8.0, "c1")
    assert w == audio.choose_windows(seg[::-1], 8.0, "c1") and len(w) == 3 and all(0.5 <= b - a <= 3.0 + 1e-9 and b <= 8.0 for a, b in w)
    s = audio.window_summary(tone(180, 8.0), w)
    assert abs(s["f0_median"] - 180) < 3 and s["voiced_ratio"] > 0.9 and len(s) == 6 + 26
    assert np.isnan(audio.window_summary(tone(180), [])["mfcc_1_mean"])


def test_multilabel_split_keeps_every_share(spark):
    import random

    r = random.Random(3)
    data = [(f"c{i}", int(r.random() < 0.5), int(r.random() < 0.05), None if r.random() < 0.1 else int(r.random() < 0.2)) for i in range(2000)]
    d = spark.createDataFrame(data, "id string, a int, b int, c int")
    got = sampling.multilabel_split(d, ["a", "b", "c"], "id", 0.2)
    held = got.where("held_out")
    assert held.count() == 400 and {x.id for x in held.collect()} == {x.id for x in sampling.multilabel_split(d.repartition(5), ["a", "b", "c"], "id", 0.2).where("held_out").collect()}
    for f in "abc":
        n, h = got.where(f"{f} = 1").count(), held.where(f"{f} = 1").count()
        assert abs(h - 0.2 * n) <= 4
    assert sampling.multilabel_split(d.limit(0), ["a"], "id", 0.2).count() == 0


def test_exact_quantiles_of_a_hot_group(spark):
    d = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 50)) as g", "cast(pmod(xxhash64(id), 9999) as double) as x")
    got = {(r.g, r.p): r.quantile for r in stats.exact_quantiles(d, ["g"], "x", [0.1, 0.5]).collect()}
    pdf = d.toPandas()
    for g in ("hot", "g1", "g49"):
        for p in (0.1, 0.5):
            assert abs(got[(g, p)] - np.quantile(pdf[pdf.g == g].x, p)) < 1e-9
