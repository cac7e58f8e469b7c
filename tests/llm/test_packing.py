import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callweave.llm import packing, tokens


def check(places, bins, histogram):
    use, seen, room = defaultdict(list), defaultdict(list), 0
    for n, a, b, lo, per, off in places:
        seen[n] += range(a, b)
        for k in range(a, b):
            use[lo + (k - a) // per].append((off + (k - a) % per * n, n))
    assert {n: sorted(v) for n, v in seen.items()} == {n: list(range(c)) for n, c in histogram.items()}
    for lo, hi, used, size in bins:
        for b in range(lo, hi):
            end = 0
            for o, n in sorted(use.pop(b)):
                assert o == end
                end += n
            assert end == used <= size
            room += size
    assert not use
    return room


@pytest.mark.parametrize("seed", range(60))
def test_plan_places_everything_once(seed):
    r = random.Random(seed)
    sizes = r.choice([[8], [4, 8], [4, 8, 16], [512, 1024, 2048]])
    h = {n: r.choice([1, 2, 3, 50, 1000]) for n in {r.randint(1, max(sizes)) for _ in range(r.randint(0, 60))}}
    check(*packing.plan(h, sizes, lambda s: s + 1), h)


@pytest.mark.parametrize("top", [16, 64, 256, 1024])
def test_plans_stay_under_their_bound(top):
    for seed in range(8):
        r = random.Random(seed)
        h = {n: r.choice([1, 2, 7, 10**6, 10**12]) for n in range(1, top + 1) if r.random() < 0.9}
        places, bins = packing.plan(h, [top // 4, top // 2, top], lambda s: s + 1)
        assert len(places) <= packing.bound(top) and len(bins) <= 3 * top


def test_one_size_is_best_fit_decreasing():
    for seed in range(60):
        r = random.Random(seed)
        items = sorted((r.randint(1, 100) for _ in range(200)), reverse=True)
        rooms = []
        for x in items:
            fit = [i for i, left in enumerate(rooms) if left >= x]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= x
            else:
                rooms.append(100 - x)
        h = {n: items.count(n) for n in set(items)}
        assert sum(hi - lo for lo, hi, *_ in packing.plan(h, [100], lambda s: s)[1]) == len(rooms)


def test_downsizes_to_contents():
    assert packing.plan({5: 1}, [8, 16], lambda s: 1)[1] == [(0, 1, 5, 8)]


def test_documents_in_sequences(spark):
    d = spark.createDataFrame([(i, n) for i, n in enumerate([3, 3, 3, 8, 21, 0, 5, 3])] + [(99, None), (0, 3)], "doc_id bigint, n bigint").withColumn("length", F.lit(1)).withColumn("offset", F.lit("x"))
    got = packing.pack(d, "doc_id", "n", [4, 8], rows_per_bucket=2).collect()
    by = defaultdict(list)
    for r in got:
        if r.sequence_id is None:
            assert r.n_tokens == 0
        else:
            by[r.sequence_id].append((r.offset, r.n_tokens, r.sequence_length))
    for x in by.values():
        x.sort()
        assert sum(n for _, n, _ in x) <= x[0][2] and all(a[0] + a[1] == b[0] for a, b in zip(x, x[1:]))
    big = sorted((r.piece_no, r.piece_start, r.n_tokens) for r in got if r.doc_id == 4)
    assert big == [(0, 0, 8), (1, 8, 8), (2, 16, 5)] and len(got) == 12
    assert packing.pack(d.limit(0), "doc_id", "n", [4, 8]).count() == 0


def test_same_length_everywhere(spark):
    d = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(3).alias("n"))
    p = packing.pack(d, "doc_id", "n", [8], rows_per_bucket=500)
    assert p.count() == 5000 and p.select("sequence_id", "offset").distinct().count() == 5000 and p.select("sequence_id").distinct().count() == 2500


def test_token_counts_are_exact(spark):
    with open(tokens.DEFAULT_VOCABULARY, "rb") as f:
        n = tokens.counter(f.read())
    texts = ["", None, "hello 안녕하세요 <|endoftext|>", "가" * 50_000]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    assert n(" " * 12_000 + "ab c") == n(" " * 9_000 + "ab c") + 3_000 and n(" " * 1_000_000) == 1_000_000 and n("\n" * 20_000) == 20_000
    assert sorted(r.n_tokens for r in tokens.with_token_counts(d, "text").collect()) == sorted(n(t) if t else 0 for t in texts)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \t\n\u00a0\u3000ab'sC9가나.,!?", max_size=60))
def test_both_ways_of_splitting_give_the_same_counts(text):
    assert BY_PARTS(text) == WHOLE(text)


with open(tokens.DEFAULT_VOCABULARY, "rb") as f:
    RAW = f.read()
WHOLE, BY_PARTS = tokens.counter(RAW), tokens.counter(RAW, 1)
