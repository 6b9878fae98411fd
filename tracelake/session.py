"""Session settings used by every query."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Lookup joins may meet one key holding a third of the rows: let AQE split it even when
    # that costs another exchange further up.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A union that claims its children's partitioning breaks once AQE changes one child's number of partitions.
    "spark.sql.unionOutputPartitioning": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  driver_memory: str | None = None, app_name: str = "tracelake") -> SparkSession:
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if master and master.startswith("local["):
        cores = master.removeprefix("local[").rstrip("]")
        builder = builder.config("spark.tracelake.spread", str(os.cpu_count() if cores == "*" else cores))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to a session somebody else created."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local session may fall back to /tmp."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="tracelake-checkpoint-")
    context.setCheckpointDir(folder)


def pinned(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later passes read the same rows even after losing executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write an expensive intermediate table once, as Parquet beside the checkpoints, and read it back: several
    consumers then share the work and each reads only its columns. Columns `by` (of few values) become folders."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder).select(*df.columns)
    out.stored_in = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that `stored` wrote, once nothing lazy reads them any more; other DataFrames are left alone."""
    for table in tables:
        folder = table.__dict__.pop("stored_in", None)
        if folder:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def version(df: DataFrame) -> str:
    """What tells one state of a table's files from another: a digest of their names, lengths and times."""
    spark, digest = df.sparkSession, hashlib.sha256()
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        state = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        digest.update(f"{name} {state.getLen()} {state.getModificationTime()}\n".encode())
    return digest.hexdigest()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a table by key into as many partitions as the session setting `spark.tracelake.spread` names;
    without it (a cluster, where the reader's split size decides) the table is left as it is, and no text is moved.
    Local sessions of this package set it, because their small test tables are a single split."""
    parts = df.sparkSession.conf.get("spark.tracelake.spread", None)
    return df.repartition(int(parts), *keys) if parts else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal a table's narrow rows into tasks of about `rows` rows each, before costly columns are derived from them: a small
    file is a single split, whatever work its rows mean. The count comes from the files' footers."""
    parts = int(df.sparkSession.conf.get("spark.tracelake.spread", None) or 1)
    return df.repartition(max(parts, -(-df.count() // rows)), *keys)
