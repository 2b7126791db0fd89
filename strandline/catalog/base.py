"""Registry of queries with their SQL, and the shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RUNTIME = 2592000.0  # 30 days: the runtime of an events source

EV = "ev AS (SELECT user_id AS source_id, event_id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS t, value, event_type AS text FROM events)"


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, event_id, t (seconds), value, text."""
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / F.lit(1e6)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), "event_id", t.alias("t"), "value", F.col("event_type").alias("text"))


def sources(ev: DataFrame, column: str = "duration") -> DataFrame:
    return ev.select("source_id").distinct().withColumn(column, F.lit(RUNTIME))


def ms(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1000 + 0.5).cast("bigint")


def big(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("bigint")


def sql_ms(x: str) -> str:
    return f"CAST(floor(({x}) * 1000 + 0.5) AS BIGINT)"
