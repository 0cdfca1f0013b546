"""Session helpers: build a local session for tests/bench, resolve the shared
checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "flipside", extra: dict | None = None) -> SparkSession:
    """Local session used by tests and bench.py. On a cluster, callers pass in
    their own session and none of these settings are forced."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # scoring is CPU-bound per row; keep small local inputs spread over the cores
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir`` (set by the cluster). Only
    when it is unset -- as in tests -- is ``fallback`` used and registered."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if fallback is None and sc.master.startswith("local"):
        # single-machine session (tests, local runs): a local folder is shared by construction
        import tempfile
        fallback = tempfile.mkdtemp(prefix="flipside-chk-")
    if fallback is None:
        raise RuntimeError("spark.checkpoint.dir is not set; the cluster must name a shared folder")
    os.makedirs(fallback, exist_ok=True)
    sc.setCheckpointDir(fallback)
    return sc.getCheckpointDir() or fallback
