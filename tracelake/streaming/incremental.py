"""Incremental runs: the stateless text detectors behind a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tracelake.operators import config, pii, secrets


def text_evidence(docs: DataFrame, text: str = "text") -> DataFrame:
    """Personal data and secrets of each document; works on batch and streaming frames alike."""
    return secrets.with_secrets(pii.with_pii(docs, text), text)


def config_evidence(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    return config.with_config(docs, path, text)


def audit_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str,
                    files_per_batch: int = 1000) -> StreamingQuery:
    """Scan Parquet files as they arrive and append their evidence; files already seen are never read again."""
    arriving = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source))
    return (text_evidence(arriving).drop("text").writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start())
