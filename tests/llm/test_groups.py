import random

from pyspark.sql import functions as F

from callweave.llm import sampling, splits
from callweave.llm.components import components


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r, k in edges:
        a, b = find(("r", r)), find(("k", k) if k is not None else ("r", r))
        parent[max(a, b)] = min(a, b)
    groups = {}
    for r, _ in edges:
        groups.setdefault(find(("r", r)), set()).add(r)
    return sorted((r, min(g)) for g in groups.values() for r in g)


def test_components_match_union_find(spark, rows):
    r = random.Random(3)
    edges = [(f"r{r.randrange(60):02d}", r.choice([None, f"k{r.randrange(40)}", "hot"]) if i % 9 == 0 else f"k{r.randrange(45)}") for i in range(90)]
    edges += [("r00", "k1"), ("r00", "k1")]
    d = spark.createDataFrame(edges, "record string, key string")
    assert rows(components(d, "record", "key"), "record", "component") == union_find(edges)


def test_a_long_chain_and_empty(spark):
    chain = [(f"r{i:04d}", f"k{j}") for i in range(300) for j in (i, i + 1)]
    c = components(spark.createDataFrame(chain, "record string, key string"), "record", "key")
    assert c.count() == 300 and c.where("component <> 'r0000'").count() == 0
    assert components(spark.createDataFrame([], "record string, key string"), "record", "key").count() == 0


CALLS = "call_id string, gender string, wav_relative_path string, caller_ref string, partition string, extra int"


def test_notation_does_not_matter(spark, rows):
    d = spark.createDataFrame(
        [
            (" A1", "M", "x/ff_1_2.wav", "C-0000aaaa", "train", 1),
            ("b2", "M", "./x\\FF_9_9.WAV", None, "Test ", 1),
            ("c3", "M", "x/ee_1_1.wav", "c_0000AAAA", None, 1),
            ("d4", "F", "x/dd_1_1.wav", "N/A", "internal-validation", 1),
            ("D4 ", "F", "x/dd_1_1.wav", "unknown", "Internal_Validation", 1),
            ("e5", "F", None, "N/A", "train", 1),
            (None, "F", "x/ff_1_1.wav", None, "test", 1),
        ],
        CALLS,
    )
    parts = d.select(splits.plain_id("call_id").alias("record"), splits.plain_partition("partition").alias("partition"))
    got = splits.divided_groups(splits.call_edges(d), parts)
    assert rows(got, "record", "component") == [("a1", "a1"), ("b2", "a1"), ("c3", "a1")]


def batch(spark, pairs):
    e = spark.createDataFrame(pairs, "record string, key string")
    return e, e.select("record").distinct().withColumn("stratum", F.lit("F"))


SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}


def test_shares_hold_and_groups_stay_together(spark, rows):
    e, s = batch(spark, [(f"r{i:04d}", f"k{i // 2}") for i in range(2000)])
    state, _ = splits.assign_splits(None, None, e, s, SHARES)
    n = {r["split"]: r["count"] for r in state.groupBy("split").count().collect()}
    assert abs(n["train"] - 1600) <= 4 and abs(n["val"] - 200) <= 4 and abs(n["test"] - 200) <= 4
    assert state.groupBy("component").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    again, _ = splits.assign_splits(None, None, e.repartition(7), s, SHARES)
    assert rows(state) == rows(again)


def test_existing_components_keep_their_split_and_conflicts_are_quarantined(spark, rows):
    e, s = batch(spark, [(f"r{i:03d}", f"k{i}") for i in range(40)])
    state, keys = (x.cache() for x in splits.assign_splits(None, None, e, s, SHARES))
    old = {r.record: r.split for r in state.collect()}
    x = next(r for r in old if old[r] == "train")
    y = next(r for r in old if old[r] != "train")
    z = next(r for r in old if old[r] == "train" and r != x)
    e2, s2 = batch(spark, [("n1", f"k{int(x[1:])}"), ("n2", f"k{int(x[1:])}"), ("n2", f"k{int(z[1:])}"), ("n3", f"k{int(z[1:])}"), ("m1", f"k{int(y[1:])}"), ("m1", "new"), ("m2", "new"), ("m3", None)])
    after, keys2 = (d.cache() for d in splits.assign_splits(state, keys, e2, s.union(s2), SHARES))
    got = {r.record: (r.component, r.split, r.status) for r in after.collect()}
    assert {r: got[r][1] for r in old} == old
    assert {got[r][0] for r in (x, z, "n1", "n2", "n3")} == {min(x, z)} and got["n1"][1:] == ("train", "kept")
    assert got["m1"][0] == got["m2"][0] == got[y][0] and got["m2"][1] == old[y] and got["m3"][2] == "new"
    e3, s3 = batch(spark, [("q", f"k{int(x[1:])}"), ("q", f"k{int(y[1:])}")])
    last, _ = splits.assign_splits(after, keys2, e3, s.union(s2).union(s3), SHARES)
    end = {r.record: (r.component, r.split, r.status) for r in last.collect()}
    assert end[x][0] == end[y][0] == end["q"][0] and end[x][2] == end[y][2] == "quarantined"
    assert end[x][1] == old[x] and end[y][1] == old[y]
    empty = splits.assign_splits(state, keys, e3.limit(0), s, SHARES)[0]
    assert rows(empty, "record", "split") == rows(state, "record", "split")


def test_new_records_of_a_torn_component_get_no_split(spark, rows):
    e, s = batch(spark, [(f"r{i:03d}", f"k{i}") for i in range(40)])
    state, keys = (x.cache() for x in splits.assign_splits(None, None, e, s, SHARES))
    old = {r.record: r.split for r in state.collect()}
    x = next(r for r in old if old[r] == "train")
    y = next(r for r in old if old[r] == "test")
    e2, s2 = batch(spark, [("q", f"k{int(x[1:])}"), ("q", f"k{int(y[1:])}")])
    after, keys2 = (d.cache() for d in splits.assign_splits(state, keys, e2, s2, SHARES))
    assert {r.record: (r.split, r.status) for r in after.where(F.col("record").isin("q", x, y)).collect()} == {"q": (None, "quarantined"), x: ("train", "quarantined"), y: ("test", "quarantined")}
    e3, s3 = batch(spark, [("t", f"k{int(y[1:])}"), ("u", "k900")])
    last = {r.record: (r.split, r.status) for r in splits.assign_splits(after, keys2, e3, s3, SHARES)[0].collect()}
    assert last["t"] == (None, "quarantined") and last["u"][1] == "new" and {r: last[r][0] for r in old} == old


def test_a_batch_is_decided_by_what_came_before(spark, rows):
    """The same first batch gives the same rows whatever comes later, strata included."""
    e, s = batch(spark, [(f"r{i:03d}", f"k{i}") for i in range(60)])
    one = splits.assign_splits(None, None, e, s, SHARES)[0].cache()
    later, s2 = batch(spark, [("z1", None), ("r001", "k7")])
    two = splits.assign_splits(one, e.select(F.col("record").alias("component"), "key"), later, s2.withColumn("stratum", F.lit("M")), SHARES)[0]
    assert rows(two.where("record <> 'z1'"), "record", "split", "stratum") == rows(one, "record", "split", "stratum")
    assert rows(two.where("record = 'z1'"), "stratum") == [("M",)]


def test_deficits_take_any_hash(spark):
    """Names whose hash is the least integer, too."""
    new = spark.createDataFrame([(f"c{i}", 1, "F", f"c{i}") for i in range(500)], "component string, n bigint, stratum string, root string")
    got = splits.fill_deficits(new, spark.createDataFrame([], splits.STATE), {"a": 1.0, "b": 1.0})
    assert sorted(r["count"] for r in got.groupBy("split").count().collect()) == [250, 250]


def test_sample_is_stable_as_rows_arrive(spark, rows):
    d = spark.createDataFrame([(f"c{i}", "p" if i % 3 else None, i) for i in range(3000)] + [("c1", "q", 9999), (None, "p", 1)], "call_id string, part string, at int")
    args = ("call_id", "part", "at")
    first = sampling.first_sight(None, d.where("at < 1500"), *args).cache()
    t1 = sampling.raise_thresholds(None, first, 0.1)
    one = {r.id for r in sampling.select(first, t1).collect()}
    assert one == {r.id for r in sampling.select(sampling.first_sight(None, d.where("at < 1500").repartition(5), *args), t1).collect()} and 90 < len(one) < 220
    more = sampling.first_sight(first, d, *args)
    assert more.join(first, "id", "left_semi").count() == 0 and more.count() == 1500
    store = first.unionByName(more)
    assert rows(store.where("id = 'c1'"), "stratum") == [("p",)]
    two = {r.id for r in sampling.select(store, sampling.raise_thresholds(t1, store, 0.02)).collect()}
    assert one <= two
    assert sampling.first_sight(store, d, *args).count() == 0
    low, high = store.agg(F.min("u"), F.max("u")).first()
    assert 0 <= low and high < 1
    assert sampling.select(store.limit(0), t1).count() == 0
