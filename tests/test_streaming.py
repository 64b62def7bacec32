"""The same windows from a stream and from a batch."""

from pyspark.sql import functions as F

from assay.streaming.incremental import windowed_accuracy


def test_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1), ("2024-01-01 00:50:00", "a", None), ("2024-01-01 01:10:00", "a", 1), ("2024-01-01 01:20:00", None, 0), (None, "a", 1)]
    df = spark.createDataFrame(rows, "t string, g string, ok int").select(F.to_timestamp("t").alias("t"), "g", "ok")
    df.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in windowed_accuracy(df, "t", "g", "ok").collect()}
    assert {(r[1], r[2], r[3]) for r in batch} == {("a", 2, 1), ("a", 1, 1), ("unknown", 1, 0)}
    stream = windowed_accuracy(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "t", "g", "ok")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("windows").collect()} == batch
