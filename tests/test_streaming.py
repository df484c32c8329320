from pyspark.sql import functions as F

from tessella.streaming import state


def test_stream_ends_as_the_batch(spark, tmp_path):
    rows = [("a", 1, "x", False), ("b", 2, "y", False), ("a", 3, "z", False), ("b", 4, "", True), ("c", 5, "w", False)]
    schema = "path string, version long, text string, closed boolean"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    state.upsert_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = state.latest(spark.read.parquet(f"{tmp_path}/out"))
    assert sorted((r.path, r.version, r.text) for r in got.collect()) == [("a", 3, "z"), ("c", 5, "w")]


def test_debounce(spark):
    rows = [("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 00:00:00.2"), ("a", 3, "2024-01-01 00:00:01")]
    df = spark.createDataFrame(rows, "path string, version long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.version, r.changes) for r in state.debounced(df).collect()) == [(2, 2), (3, 1)]


def test_ingestion_takes_back(spark, tmp_path):
    from tessella.streaming import state

    schema = "coordinate string, name string"
    source, target = tmp_path / "in", str(tmp_path / "out")
    for k, rows in enumerate(([("g:a", "A"), ("g:b", "B")], [("g:a", "A2")], [("g:b", "B2")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        state.ingest_stream(spark.readStream.schema(schema).parquet(str(source)), target, str(tmp_path / "at"), ["coordinate"]).awaitTermination()
    got = state.ingested(spark.read.parquet(target), ["coordinate"])
    assert sorted((r.coordinate, r.name, r.tier) for r in got.collect()) == [("g:a", "A2", "Durable"), ("g:b", "B2", "Durable")]
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")]) == 2
