from pyspark.sql import functions as F

from skyloom.operators.som import Som
from skyloom.streaming.running import RunningStats, activation_stream, windowed_density


def test_running_stats_over_two_batches(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "x double"
    stats = RunningStats(spark, str(tmp_path / "state"))
    for lo in (0, 10):
        spark.range(lo, lo + 10).select(F.col("id").cast("double").alias("x")).coalesce(1).write.mode("append").parquet(src)
        stats.start(spark.readStream.schema(schema).parquet(src), "x", str(tmp_path / "cp")).awaitTermination()
    r = stats.result().first()
    assert (r.n, r.mean, r.minimum, r.maximum) == (20, 9.5, 0.0, 19.0) and abs(r["std"] - 5.916079783) < 1e-6


def test_activation_stream(spark, tmp_path):
    src = str(tmp_path / "v")
    spark.range(20).select(F.array((F.col("id") % 2).cast("double"), F.lit(0.0)).alias("v")).write.parquet(src)
    som = Som(2, 1, 2, "square")
    som.weights[1, 0] = 1.0
    activation_stream(spark.readStream.schema("v array<double>").parquet(src), som, "v", "act", str(tmp_path / "cp")).awaitTermination()
    assert {r.neuron: r["count"] for r in spark.table("act").collect()} == {0: 10, 1: 10}


def test_windows(spark, tmp_path):
    src = str(tmp_path / "e")
    spark.range(48).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.lit("a").alias("k"), F.lit(1.0).alias("x")).write.parquet(src)
    stream = windowed_density(spark.readStream.schema("ts timestamp, k string, x double").parquet(src), "ts", "k", "x")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("win").collect()) == [24, 24]
