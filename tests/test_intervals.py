import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from callweave.operators import intervals as iv
from callweave.operators.ordered import previous_in_order, run_numbers, running_count, value_ranks

U = "call_id string, startAt bigint, endAt bigint, n int, value string"


def brute(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def frame(spark, spans, call="a"):
    return spark.createDataFrame([(call, s, e, 1, "x") for s, e in spans], U)


def test_fixture_values(spark, rows):
    d = frame(spark, [(0, 2), (1, 3), (4, 5)])
    assert rows(iv.periods(d, ["call_id"]), "period_start", "period_end") == [(0, 3), (4, 5)]
    assert rows(iv.gaps(d, ["call_id"])) == [("a", 3, 4)]
    a = spark.createDataFrame([("c", 0, 3)], "k string, start_ms bigint, end_ms bigint")
    b = spark.createDataFrame([("c", 2, 4)], a.schema)
    c = spark.createDataFrame([("c", 3, 4)], a.schema)
    assert rows(iv.bucketed_overlap(a, b, ["k"])) == [("c", 1)]
    assert iv.bucketed_overlap(a, c, ["k"]).count() == 0
    assert rows(iv.bucketed_overlap(a, b, ["k"], width=1)) == [("c", 1)]


def test_bad_rows_ties_and_nulls(spark, rows):
    d = spark.createDataFrame(
        [("a", 0, 10, 1, ""), ("a", 0, 10, 2, ""), ("a", None, 5, 1, None), ("a", 50, 40, 1, ""), ("a", -5, 90, 1, ""), ("a", 20, 20, 1, ""), ("a", 10, 12, 1, ""), (None, 1, 2, 1, ""), (None, 5, 6, 1, "")], U
    )
    assert rows(iv.periods(d, ["call_id"]), "call_id", "period_start", "period_end") == [(None, 1, 2), (None, 5, 6), ("a", 0, 12)]
    assert rows(iv.gaps(d, ["call_id"])) == [(None, 2, 5)]


def test_empty(spark):
    d = spark.createDataFrame([], U)
    assert iv.periods(d, ["call_id"]).count() == 0 and iv.gaps(d, ["call_id"]).count() == 0


def test_one_entity_over_many_buckets_matches_brute_force(spark, rows):
    r = random.Random(5)
    spans = [(s := r.randrange(0, 40_000), s + r.choice([1, 7, 30, 200])) for _ in range(900)]
    want = brute(spans)
    d = frame(spark, spans)
    assert rows(iv.periods(d, ["call_id"], width=100), "period_start", "period_end") == sorted(map(tuple, want), key=lambda t: tuple((True, str(x)) for x in t))
    assert iv.gaps(d, ["call_id"], width=100, min_gap=20).count() == sum(b[0] - a[1] >= 20 for a, b in zip(want, want[1:]))


def test_periods_are_numbered_and_ends_come_from_later_buckets(spark, rows):
    """A long span covers empty buckets; the hot entity has a period in every other one; a null entity is one of its own."""
    d = spark.createDataFrame([("h", 200 * i, 200 * i + 60, 1, "") for i in range(30)] + [("l", 0, 5000, 1, ""), ("l", 10, 20, 1, ""), ("l", 4900, 4950, 1, ""), ("l", 9000, 9001, 1, ""), (None, 5, 6, 1, ""), (None, 500, 501, 1, "")], U)
    got = rows(iv.periods(d, ["call_id"], width=100))
    want = [(None, 1, 5, 6), (None, 2, 500, 501), ("l", 1, 0, 5000), ("l", 2, 9000, 9001)] + [("h", i + 1, 200 * i, 200 * i + 60) for i in range(30)]
    assert sorted(got, key=str) == sorted(want, key=str)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 15)), min_size=1, max_size=25), st.integers(1, 30))
def test_periods_property(spark, raw, width):
    spans = [(s, s + n) for s, n in raw]
    got = sorted((r.period_start, r.period_end) for r in iv.periods(frame(spark, spans), ["call_id"], width=width).collect())
    assert got == [tuple(x) for x in brute(spans)]


def test_small_union_is_the_same(spark, rows):
    d = frame(spark, [(0, 2), (2, 3), (4, 5)])
    assert rows(iv.union_small(d, ["call_id"], "startAt", "endAt"), "start_ms", "end_ms") == [(0, 3), (4, 5)]


def test_ranks_neighbours_and_counts_cross_buckets(spark, rows):
    d = spark.createDataFrame([("a", v, i) for i, v in enumerate([5, 5, 40, 41, 90])], "k string, v bigint, i int")
    assert rows(value_ranks(d, ["k"], "v", 10), "value", "n", "before", "through") == [(40, 1, 2, 3), (41, 1, 3, 4), (5, 2, 0, 2), (90, 1, 4, 5)]
    assert rows(previous_in_order(d, ["k"], "v", ["i"], 10, ["i"]), "i", "prev_i") == [(0, None), (1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(running_count(d, ["k"], "v", d.i % 2 == 0, "c", 10, ["i"]), "i", "c") == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 40), st.sampled_from(["x", "y", None])), min_size=1, max_size=30), st.integers(1, 15))
def test_run_numbers_property(spark, data, width):
    d = spark.createDataFrame([(*t, i) for i, t in enumerate(data)], "k string, v bigint, s string, i int")
    got = {r.i: r.n for r in run_numbers(d, ["k"], "v", "s", "n", width, ["i"]).collect()}
    want = {}
    for k in ("a", "b", None):
        n, last = 0, object()
        for v, i, s in sorted(((v, i, s) for i, (e, v, s) in enumerate(data) if e == k), key=lambda t: t[:2]):
            n, last = (n, last) if s == last else (n + 1, s)
            want[i] = n
    assert got == want
