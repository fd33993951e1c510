"""Structured streams of edges: counts that grow with each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_edge_text(spark: SparkSession, path: str) -> DataFrame:
    """A stream of ``src dst`` files that arrive in a folder."""
    return spark.readStream.schema("src long, dst long").options(sep=" ", mode="FAILFAST").csv(path)


def streaming_degrees(edges: DataFrame) -> DataFrame:
    """Out-degrees so far, for output modes update and complete: state is a row a vertex."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))
