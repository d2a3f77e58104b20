"""Tables whose files keep arriving: histograms over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import hist


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def running_hist(stream: DataFrame, x: str, axis: hist.Axis) -> DataFrame:
    """A fill that grows with the stream; its state has a row a bin. For output mode complete or update."""
    return hist.fill(stream, x, axis)
