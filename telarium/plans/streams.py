"""Queries that run as streams over the files that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telarium.streaming import files as S


def x1_stream_windows(spark, sf_dir: str) -> DataFrame:
    """Daily counts and sums of each kind of event."""
    return S.run(S.tumbling(S.events(spark, f"{sf_dir}/event[s].parquet")), "complete", "ventanas")


def x2_stream_state(spark, sf_dir: str) -> DataFrame:
    """Count and greatest value of each user, kept in state."""
    found = S.run(S.totals(S.events(spark, f"{sf_dir}/event[s].parquet").where("user_id is not null and value is not null")), "update", "usuarios")
    return found.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max("mayor"), 4).alias("mayor"))


QUERIES = {"x1_stream_windows": x1_stream_windows, "x2_stream_state": x2_stream_state}
SQL = {
    "x1_stream_windows": "select strftime(ts, '%Y-%m-%d') as dia, event_type, count(*) as n, round(sum(value), 2) as valor from events group by 1, 2",
    "x2_stream_state": "select user_id, count(*) as n, round(max(value), 4) as mayor from events where user_id is not null and value is not null group by 1",
}
