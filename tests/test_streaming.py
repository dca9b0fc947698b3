from quillframe.operators import text
from quillframe.streaming import text as S


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"One two {i}. Three four! {'x ' * i}") for i in range(20)], "artifact_id long, text string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.measured(stream).writeStream.format("memory").queryName("measured").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("measured").collect()} == {tuple(r) for r in S.measured(rows).collect()}
    assert {(r["artifact_id"], r["word_count"]) for r in spark.table("measured").collect()} == {(r["artifact_id"], r["word_count"]) for r in text.lexical_scalars(rows).collect()}


def test_windows(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 20) AS ts, 'a' AS kind FROM range(6)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    S.windowed(stream, "ts", ["kind"]).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [3, 3]
