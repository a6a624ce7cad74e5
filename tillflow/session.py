"""Session defaults.

Only behaviour is fixed here (UTC, adaptive execution, skew splitting). Sizing such as the
number of shuffle partitions is left to the cluster: adaptive execution coalesces a generous
initial number at run time, so the same code serves a laptop and a thousand executors.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "snappy",
    # Recording the Python call site of every column expression costs more than building it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# Spark's own setting: the shuffle files of an execution are deleted when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app: str = "tillflow", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def materialize(df: DataFrame, name: str, free_shuffles: bool = False) -> DataFrame:
    """Write a frame once below the shared folder and read it back.

    For frames that several passes use: the passes then scan the columns they need instead of
    repeating the joins behind the frame, and a lost executor costs a re-read, not a re-computation.
    With ``free_shuffles`` the files of the shuffles behind the frame are deleted when it is written; otherwise
    they lie on the executors' disks until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, None)
    try:
        if free_shuffles:
            spark.conf.set(FREE_SHUFFLES, "true")
        df.write.mode("overwrite").parquet(path)
    finally:
        if free_shuffles and before is None:
            spark.conf.unset(FREE_SHUFFLES)
        elif free_shuffles:
            spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.parquet(path)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder the session names.

    Scratch output must be readable by every executor, so a machine-local temporary folder is
    used only when the session names no shared one (single-machine tests).
    """
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(os.environ.get("TILLFLOW_SCRATCH", "/tmp"), "tillflow")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
