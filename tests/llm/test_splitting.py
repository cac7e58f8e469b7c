import json
import math
import random

from pyspark.sql import functions as F

from callweave.llm import splitting as sp


def fewest(lengths, limit):
    n, fill = (1, 0) if lengths else (0, 0)
    for x in lengths:
        if fill + x > limit:
            n, fill = n + 1, 0
        fill += x
    return n


def test_cuts_are_fewest_and_within_the_limit():
    for seed in range(400):
        r = random.Random(seed)
        limit = r.choice([10, 50, 1000])
        lengths = [r.randint(1, limit) for _ in range(r.randint(1, 40))]
        cuts = sp.cut_runs(lengths, [r.randint(0, 9) for _ in lengths], limit)
        edges = [0, *cuts, len(lengths)]
        assert all(a < b and sum(lengths[a:b]) <= limit for a, b in zip(edges, edges[1:]))
        assert len(edges) - 1 == fewest(lengths, limit)


def test_snaps_to_the_longest_pause_near_the_target():
    assert sp.cut_runs([2] * 8, [9, 9, 1, 2, 5, 9, 9, 0], 12) == [5] and sp.cut_runs([2] * 8, [9, 9, 6, 2, 5, 9, 9, 0], 12) == [3]


def test_long_segments_alone_with_overlap():
    for n in (15_001, 29_000, 29_001, 43_000, 43_001, 100_000):
        got = sp.split_segments([(0, 100), (200, 200 + n), (300_000, 300_100)], 15_000, 1_000)
        cut = [p for p in got if p[5]]
        assert len(cut) == 1 + math.ceil((n - 15_000) / 14_000) and len(got) == len(cut) + 2
        assert all(p[3] <= 15_000 for p in got) and all(a[2] - b[1] == 1_000 for a, b in zip(cut, cut[1:]))
        assert cut[0][1] == 200 and cut[-1][2] == 200 + n


def test_nulls_repeats_and_clashing_columns(spark, rows):
    data = [("a", json.dumps([[0, 10], [0, 10], [20, 15], [30, 40]])), ("b", None), ("c", "[]"), ("d", "no json"), ("e", "[[5, 9, 1], [null, 4]]"), (None, "[[0, 5]]")]
    d = spark.createDataFrame([(*x, 1, 2) for x in data], "call_id string, s string, p int, piece_no int")
    assert rows(sp.piece_counts(d, "call_id", sp.segments_from_json("s"))) == rows(spark.createDataFrame([(None, 0), ("a", 1), ("b", 0), ("c", 0), ("d", 0), ("e", 0)], "k string, n bigint"))
    assert sp.pieces(d.limit(0), "call_id", sp.segments_from_json("s")).count() == 0
    got = sp.pieces(d, "call_id", sp.segments_from_json("s")).where("call_id = 'a'").first()
    assert (got.piece_start, got.piece_end, got.length, got.n_segments, got.cut) == (0, 40, 20, 2, False)


def test_rows_of_one_item_are_one_item(spark, rows):
    d = spark.createDataFrame([("a", "[[0, 9000]]"), ("a", "[[0, 9000], [10000, 15000]]"), ("a", None), ("b", None)], "k string, s string")
    m = sp.merged(d, "k", sp.segments_from_json("s"))
    assert rows(sp.piece_counts(m, "k", F.col("segments"))) == [("a", 1), ("b", 0)]


def test_a_very_long_item(spark):
    segs = [[i * 100, i * 100 + 60] for i in range(20_000)]
    d = spark.createDataFrame([("a", json.dumps(segs))], "k string, s string")
    assert sp.pieces(d, "k", sp.segments_from_json("s")).agg(F.max("length"), F.sum("length")).first()[1] == 20_000 * 60
