"""Session and scratch-space helpers.

Library code never invents storage locations on a cluster: anything that must
be written (materialised marts, streaming state, exports without an explicit
path) goes under the shared folder named by ``spark.checkpoint.dir``. Only when
that setting is absent (local tests, the bench) do we pick a fresh local
folder ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(master: str = "local[*]", app_name: str = "alertlens",
                  shuffle_partitions: int | None = None,
                  extra_conf: dict[str, str] | None = None) -> SparkSession:
    """A session for tests and the bench. Cluster jobs bring their own."""
    cpus = os.cpu_count() or 8
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get(_CHECKPOINT_KEY, None)
    if not configured:
        try:
            configured = spark.conf.get(_CHECKPOINT_KEY)
        except Exception:  # noqa: BLE001 - unset key raises in some versions
            configured = None
    if not configured:
        # Unset: local mode (tests, bench, the driver's smoke run). Elsewhere every
        # executor would write to a disk of its own.
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="alertlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/alertlens/{name}-{uuid.uuid4().hex[:12]}"
