"""Session helpers: the shared folder for checkpoints, models and stream state."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, app_name: str = "tabassay", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a fresh
    temporary folder, because driver and executors are one process there.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    created = tempfile.mkdtemp(prefix="tabassay-")
    spark.conf.set(CHECKPOINT_DIR, created)
    return created


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def enable_checkpoints(spark: SparkSession) -> None:
    """Point ``DataFrame.checkpoint`` and the iterative learners at the shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    local = context.master.startswith("local")
    if spark.conf.get(CHECKPOINT_DIR, None) or local:
        context.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")
    else:
        warnings.warn(f"{CHECKPOINT_DIR} is not set; long lineages are kept", stacklevel=2)
