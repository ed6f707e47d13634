"""Structured Streaming over files: windowed counts with watermark, and stateful sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from telarium.session import table_path

IDLE = 7 * 24 * 3600 * 1000  # milliseconds


def events(spark: SparkSession, path: str) -> DataFrame:
    """The events as a stream of files (path is a pattern); local timestamps become instants of the session's zone."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs the stream over what is there; each batch replaces the result of its trigger in the shared folder."""
    spark = stream.sparkSession
    out, check = table_path(spark, name), table_path(spark, f"{name}-estado")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/lote={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.parquet(out)
    return found.drop("lote") if mode != "complete" else found


def tumbling(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums of each kind in windows, behind a watermark."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("valor")).select(F.date_format("w.start", "yyyy-MM-dd").alias("dia"), "event_type", "n", "valor")


def totals(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Custom state: running count and greatest value of each user, one row when a batch has seen them.

    The state of a user is dropped when the watermark is IDLE milliseconds past their last event, so the store doesn't grow with all users ever.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, top = state.get if state.exists else (0, float("-inf"))
        seen = 0
        for b in batches:
            if b["ts"].notna().any():
                seen = max(seen, int(b["ts"].max().timestamp() * 1000))
            n, top = n + len(b), max(top, float(b["value"].max()))
        state.update((n, top))
        state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + IDLE)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "mayor": [top]})

    return stream.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, mayor double", "n long, mayor double", "update", GroupStateTimeout.EventTimeTimeout)
