"""Saved state of unfinished books as a table: results are appended once, not rewritten with every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["book_id", "page"]


def append(results: DataFrame, path: str, batch: int) -> None:
    """Adds a batch of results; the same batch written again replaces itself, so a retried batch changes nothing."""
    results.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The newest result of each page."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rest = [c for c in rows.columns if c not in (*KEYS, "batch")]
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*KEYS, *(F.col(f"r.{c}").alias(c) for c in rest))


def sink(stream: DataFrame, path: str, checkpoint: str):
    """A stream of results into the cache, batch by batch; starts where the checkpoint left off."""
    return stream.writeStream.foreachBatch(lambda df, n: append(df, path, n)).option("checkpointLocation", checkpoint)
