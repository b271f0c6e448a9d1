"""Sinks that can be repeated without doubling rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_text(df: DataFrame, path: str, column: str = "value", files: int | None = None) -> None:
    """One text line per row, replacing what was there; ``files`` bounds the number of files."""
    lines = df.select(column)
    if files:
        lines = lines.repartition(files)
    lines.write.mode("overwrite").text(path)


def write_batch(df: DataFrame, path: str, batch_id: int, run_id: str = "run") -> None:
    """Rows of one micro-batch under their own key; a replay replaces them."""
    df.write.mode("overwrite").parquet(f"{path}/run_id={run_id}/batch_id={int(batch_id)}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/run_id=*")
