from tessera.sources.tables import read
from tessera.streaming import history


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/event*.parquet")
    run = history.daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {tuple(r) for r in spark.table("days").collect()}
    expected = {tuple(r) for r in history.daily_counts(batch).collect()}
    assert got == expected and got


def test_changed_rows(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "x int"), spark.createDataFrame([(1,), (1,), (1,), (2,)], "x int")
    assert sorted(r.x for r in history.changed_rows(a, b).collect()) == [1, 2]
