"""Streams of operations: files of a log arrive, a delta table and its snapshot follow."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.operators.buffer import BufferedMap
from tagweave.plans.snapshot import manifest


def follow_log(spark: SparkSession, source: str, schema, delta_dir: str, checkpoint: str, max_files: int = 64):
    """Append each micro-batch of Parquet operations (k, v, seq, op) in `source` to `delta_dir`.

    `seq` decides which operation wins, so late and reordered files need no watermark. A batch is
    written under its own id and overwritten when it is retried: each operation arrives once.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.filter(F.col("k").isNotNull()).write.mode("overwrite").parquet(os.path.join(delta_dir, f"batch={batch_id}"))

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def published(base: DataFrame, delta_dir: str, width: int = 16) -> DataFrame:
    """Manifest of base (+) everything that has arrived."""
    delta = base.sparkSession.read.parquet(delta_dir).drop("batch")
    return manifest(BufferedMap(base, delta).read().df, width)
