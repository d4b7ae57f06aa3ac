"""Session helpers.

The library never builds its own session inside an operator; these helpers are
for scripts, tests and the bench.  On a cluster ``spark.checkpoint.dir`` names
a shared folder and is respected as is; only when it is unset (local tests) a
fresh scratch folder is assigned.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "shelfcast", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, assigning a scratch one only if unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return spark.sparkContext.getCheckpointDir()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    scratch = tempfile.mkdtemp(prefix="shelfcast-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", scratch)
    spark.sparkContext.setCheckpointDir(scratch)
    return spark.sparkContext.getCheckpointDir()


def compiled_projections(spark: SparkSession) -> None:
    """Keep generated methods within what the JVM compiles.

    It interprets methods of more than 8,000 bytes.  Wide projections and aggregates beyond that run
    as operators of their own instead, whose code Spark cuts into small methods.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


#: Folders of tables that this process has written, by application.
_WRITTEN: dict[str, list[str]] = {}


def drop_tables(spark: SparkSession) -> int:
    """Remove the tables that ``materialize`` has written for this application; returns how many.

    Frames built on them cannot be read afterwards: call it when the results are stored.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


def materialize(df, how: str = "table"):
    """Cut lineage of a frame that several actions reuse.

    ``table`` (default) writes Parquet under the shared checkpoint folder and
    reads it back: one job, columnar and compressed, and later reads get column
    pruning and filter pushdown; it survives executor loss.  ``checkpoint`` is
    Spark's RDD checkpoint into the same folder; ``persist`` keeps blocks on
    executors; ``none`` returns ``df``.
    """
    if how in ("table", "checkpoint") and df.isStreaming:
        return df
    if how == "table":
        base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
        path = f"{base}/tables/{uuid.uuid4().hex}"
        _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.parquet(path)
    if how == "checkpoint":
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if how == "persist":
        from pyspark import StorageLevel
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df
