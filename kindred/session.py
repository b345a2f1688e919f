"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. Times are UTC; joins and partition counts are left to
# adaptive execution, which sees real shuffle sizes. Rows that go to few folders are not sorted by
# these first; beyond so many folders in a task Spark sorts them after all.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.maxConcurrentOutputFileWriters": "16",
}


CHECKPOINT_DIR = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Set what every job relies on.

    Work folders lie in ``spark.checkpoint.dir``, a folder that all executors share. A session
    that runs in one process and has none gets one folder of this machine for its lifetime.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if not spark.conf.get(CHECKPOINT_DIR, None) and spark.sparkContext.isLocal:
        folder = tempfile.mkdtemp(prefix="run-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set(CHECKPOINT_DIR, folder)
    return spark


def local_session(
    cores: str | int = "*", memory: str = "16g", settings: dict[str, str] | None = None
) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kindred")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables and stream checkpoints.

    It lies in the shared folder named by ``spark.checkpoint.dir``.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not root:
        root = configure(spark).conf.get(CHECKPOINT_DIR, None)
    if not root:
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")
