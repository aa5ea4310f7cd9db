from tripwright.operators.seen import SeenStore
from tripwright.streaming.delivery import first_deliveries


def test_each_message_once_over_batches_and_replays(spark, tmp_path):
    schema = "id bigint, v string, t bigint, note string"
    batches = [[(1, "a", 1, "x"), (2, "a", 1, "y")], [(3, "a", 1, "z"), (4, "b", 1, None)], [(5, None, 1, "n"), (6, "b", 2, "m")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = first_deliveries(
            spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), "v", "t",
            lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}")),
        )
        q = out.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 4, 6]
    store = SeenStore(spark, str(tmp_path / "store"))
    name = store._read(2)["batch"]
    assert name.endswith("/1") and not name.startswith("None")
    again = store.absorb(spark.createDataFrame([(9, "zz", 9)], "id bigint, k string, at bigint"), name)
    assert [r.id for r in again.collect()] == [4]
    # another query on the same store counts its batches from 0 anew, and is no replay
    spark.createDataFrame([(20, "b", 2, "old"), (21, "c", 1, "new")], schema).coalesce(1).write.parquet(str(tmp_path / "in2"))
    other = first_deliveries(spark.readStream.schema(schema).parquet(str(tmp_path / "in2")), str(tmp_path / "store"), "v", "t", lambda df, n: df.write.parquet(str(tmp_path / "out2")))
    q = other.option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None and [r.id for r in spark.read.parquet(str(tmp_path / "out2")).collect()] == [21]
