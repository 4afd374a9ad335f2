"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Batches of long texts or wide vectors are cut by bytes, not only by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Single-machine session used by tests and the benchmark."""
    # On one machine its own temporary folder is the shared one; it goes when the process ends.
    if "spark.checkpoint.dir" not in conf:
        folder = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        conf["spark.checkpoint.dir"] = folder
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lectern")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_utc(spark: SparkSession) -> SparkSession:
    """Event times in the inputs carry no zone; read them as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


# Folders of local masters that this process made and removes when it ends.
_own: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and written intermediates, visible to every executor.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a folder of its own; elsewhere a missing setting is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = os.path.join(tempfile.gettempdir(), f"lectern-{spark.sparkContext.applicationId}")
    if folder not in _own:
        _own.add(folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
