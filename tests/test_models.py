def test_one_vs_rest_models_every_label(spark, tmp_path):
    from callweave.queries.all import QUERIES

    rows = [(i, [float(i % 23 == j) for j in range(64)], i % 23) for i in range(23 * 12)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.label: r.support for r in QUERIES["one_vs_rest"](spark, str(tmp_path)).collect()}
    assert got.keys() == {f"y{x}" for x in range(23)} and all(n > 0 for n in got.values())
