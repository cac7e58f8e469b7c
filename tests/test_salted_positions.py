import hashlib


def test_salted_positions_has_every_id(spark, rows, tmp_path):
    from callweave.queries.all import QUERIES

    ids = [f"c{i}" for i in range(300)]
    spark.createDataFrame([(i,) for i in [*ids, "c7", None]], "call_id string").repartition(5).write.parquet(f"{tmp_path}/mission1_manifest.parquet")
    order = sorted([*ids, "c7"], key=lambda i: (hashlib.sha256(f"benchmark42{i}".encode()).hexdigest(), i))
    got = QUERIES["salted_positions"](spark, str(tmp_path))
    assert rows(got, "position", "call_id") == sorted(((n, i) for n, i in enumerate(order, 1)), key=lambda r: tuple((True, str(x)) for x in r))
