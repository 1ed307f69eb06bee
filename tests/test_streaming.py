from sparkloom.streaming.replicates import count_arrivals, counted


def test_counts_add_up_over_arrivals(spark, tmp_path):
    schema = "replicate int, s double"
    cuts = spark.createDataFrame([(0.5,), (2.0,)], "threshold double")
    for k, rows in enumerate([[(0, 0.1), (0, 0.7)], [(0, 3.0), (1, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
        for _ in range(2):
            count_arrivals(spark, f"{tmp_path}/in", schema, "s", cuts, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert {tuple(r) for r in counted(spark, f"{tmp_path}/out").collect()} == {(0.5, 0, 2), (2.0, 0, 1), (0.5, 1, 0), (2.0, 1, 0)}
