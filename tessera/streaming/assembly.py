"""Assembly of a stream: contributions are folded as they come, by Structured Streaming's stateful aggregates.

folded_stream() and last_stream() keep a state for each key; run_once() writes the whole fold again after
each batch. windowed_stream() keeps state for open windows alone: with run_append() a window is written
once, when the watermark has passed it, its state is freed, and contributions that come later are
left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import aggregate


def folded_stream(contributions: DataFrame, keys: tuple[str, ...] = ("i",), op: str = "add") -> DataFrame:
    """The running fold of a stream of contributions (keys, v); for output modes update and complete."""
    return contributions.groupBy(*keys).agg(aggregate(op, F.col("v")).alias("v"))


def last_stream(contributions: DataFrame, order: str, keys: tuple[str, ...] = ("i",)) -> DataFrame:
    """The contribution of each key that is last in order, whatever order they come in (copy assembly)."""
    return contributions.groupBy(*keys).agg(F.max_by("v", order).alias("v"))


def windowed_stream(contributions: DataFrame, time: str, length: str, late: str, keys: tuple[str, ...] = ("i",), op: str = "add") -> DataFrame:
    """A fold per time window; in append mode, windows before the watermark (late behind the latest time) are final: contributions to them are left out and their state is freed."""
    return contributions.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, length).alias("w"), *keys).agg(aggregate(op, F.col("v")).alias("v")).select(F.col("w.start").alias("start"), *keys, "v")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all there is and stop. The complete fold is written to path after each batch and read from there."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_append(stream: DataFrame, path: str, checkpoint: str) -> tuple[DataFrame, list[dict]]:
    """Process all there is, batch by batch, and stop: (final windows, what each batch reported).

    Each batch adds its final windows to path; a batch that is repeated after a failure writes the
    same folder again. Reports have the number of rows read, of rows of state, and of groups of late rows that were left out.
    """

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={k}")

    query = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    reports = [{"rows": p["numInputRows"], "state": sum(s["numRowsTotal"] for s in p["stateOperators"]), "late": sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])} for p in query.recentProgress]
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/batch=*"), reports
