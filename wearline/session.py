"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# A broadcast of this many narrow rows stays around 10 MB.
MAX_BROADCAST_ROWS = 200_000

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # One BLAS thread per Python worker; parallelism comes from tasks.
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
}


def get_session(app: str = "wearline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own; anywhere else a
    machine-local folder would lose data with its machine, so the setting is required.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured:
        configured = spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    fresh = tempfile.mkdtemp(prefix="wearline-")
    spark.conf.set(CHECKPOINT_CONF, fresh)
    return fresh


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; never an existing one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written copy."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` wrote, once nothing reads them any more.

    Each must be the frame as ``materialize`` returned it; other files are refused.
    """
    for df in tables:
        for folder in {path.rpartition("/")[0] for path in df.inputFiles()}:
            if not re.fullmatch(r"table-[0-9a-f]{32}", folder.rpartition("/")[2]):
                raise ValueError(f"{folder} is no table of this library")
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when a bounded count proves it small.

    Reads at most ``max_rows + 1`` rows' worth of result. Larger inputs come back unmarked,
    and the join falls to a shuffle join with AQE skew handling.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
