"""Streaming forms of mergeable aggregates: statistics and activation maps that grow with each micro-batch, and windowed densities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyloom.functions.numeric import finite
from skyloom.operators.som import Som

_STATE = "batch long, key string, n long, mean double, m2 double, lo double, hi double"


class RunningStats:
    """Count, mean and squares about the mean of each micro-batch, under its batch number; replays of a batch overwrite it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, part: DataFrame, batch: int) -> None:
        part.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def start(self, stream: DataFrame, value: str, checkpoint: str, by: str | None = None) -> StreamingQuery:
        x = F.col(value).cast("double")
        key = F.lit("all") if by is None else F.col(by).cast("string")

        def merge(rows: DataFrame, batch: int) -> None:
            self._append(rows.filter(finite(x)).groupBy(key.alias("key")).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("lo"), F.max(x).alias("hi")), batch)

        return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def result(self) -> DataFrame:
        """(key, n, mean, rms, std, minimum, maximum) of all batches so far."""
        parts = self.spark.read.schema(_STATE).parquet(self.path)
        total = parts.groupBy("key").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.min("lo").alias("minimum"), F.max("hi").alias("maximum"))
        about = parts.select("key", F.col("n").alias("k"), F.col("mean").alias("m"), "m2").join(total, "key")
        moved = about.groupBy("key", "n", "mean", "minimum", "maximum").agg(F.sum(F.col("m2") + F.col("k") * F.pow(F.col("m") - F.col("mean"), 2)).alias("m2"))
        var = F.col("m2") / F.when(F.col("n") > 1, F.col("n") - 1)
        return moved.select("key", "n", "mean", F.sqrt(F.col("mean") * F.col("mean") + F.col("m2") / F.col("n")).alias("rms"), F.sqrt(var).alias("std"), "minimum", "maximum")


def activation_stream(stream: DataFrame, som: Som, vector: str, name: str, checkpoint: str) -> StreamingQuery:
    """Rows by best neuron of an unbounded stream, as an in-memory table of a row a neuron."""
    counts = som.winners(stream.select(vector), vector).groupBy("neuron").count()
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_density(stream: DataFrame, ts: str, by: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, by, n, total) of event-time windows; state for a window is dropped once the watermark has passed it."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), by, "n", "total")
