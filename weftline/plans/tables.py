"""The test tables as inputs of the operators, with the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts):
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return (F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / F.lit(1000)).cast("decimal(20,3)")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of their user: st from 2024 on, en by their value, both in milliseconds."""
    ms = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 1000") - F.lit(1704067200000)
    e = table(spark, sf_dir, "events").withColumn("st", ms.cast("bigint"))
    return e.withColumn("en", F.col("st") + F.floor(F.col("value") * 1000).cast("bigint") * 60)


IV = """iv AS (
  SELECT *, st + floor(value * 1000)::BIGINT * 60 AS en
  FROM (SELECT *, (epoch_us(ts) // 1000 - 1704067200000)::BIGINT AS st FROM events))"""
