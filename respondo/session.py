"""Session helpers: a tuned local session for tests/bench and a shared
folder for lineage cuts and stage tables.

On a cluster the session comes from the caller; we only *read* its
``spark.checkpoint.dir``. A directory is created here only when that
setting is missing (local tests), never on a real cluster.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "respondo") -> SparkSession:
    """Session used by tests and bench.py (local mode)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.parquet.filterPushdown", "true")
        # wide one-pass aggregations (profiling, correlations) keep codegen
        .config("spark.sql.codegen.maxFields", "1000")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written stage tables.

    Read from ``spark.checkpoint.dir`` (the cluster's shared store). Only
    in local mode, when it is unset (tests), a temporary folder is created
    and registered; on a cluster an unset value is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            # a machine-local folder would not survive executor loss
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
        root = tempfile.mkdtemp(prefix="respondo-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder (one per call, never reused)."""
    return f"{shared_dir(spark)}/respondo/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable lineage cut that survives executor loss (no localCheckpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: several jobs read
    files instead of recomputing it or holding it in executor memory."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
