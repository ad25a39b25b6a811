from tessera.streaming import history, sessions


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_late_rows_are_dropped(spark, tmp_path):
    """In append mode a window is given once the watermark has passed it, without the rows that came after."""
    schema, day = "ts timestamp, event_type string", lambda d: f"2024-01-{d:02d} 12:00:00"
    (tmp_path / "in").mkdir()
    stream = history.daily_counts(stream_of(spark, tmp_path / "in", schema), "2 days")
    for i, days in enumerate([[1, 1, 2], [10], [1, 9], [20]]):
        spark.createDataFrame([(day(d), "a") for d in days], "ts string, event_type string").selectExpr("cast(ts AS timestamp) AS ts", "event_type").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        run.awaitTermination(120)
    got = {(r.day.day, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 2), (2, 1), (9, 1), (10, 1)}


def test_upsert_keeps_the_newest_and_repeats_nothing(spark, tmp_path):
    write = sessions.upsert(str(tmp_path / "state"), ["key"], "version")
    rows = lambda *r: spark.createDataFrame(list(r), "key string, version int, value string")
    write(rows(("a", 1, "x"), ("b", 1, "y")), 0)
    write(rows(("a", 3, "z"), ("b", 0, "old")), 1)
    write(rows(("a", 9, "again")), 1)  # the same batch given again
    write(rows(("c", 1, "w")), 2)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "state" / "v=2")).collect()} == {("a", 3, "z"), ("b", 1, "y"), ("c", 1, "w")}


def test_newest_results(spark):
    r = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "key string, version int")
    assert {tuple(x) for x in sessions.newest(r, spark.createDataFrame([("a", 2), ("b", 2)], "key string, version int")).collect()} == {("a", 2)}
