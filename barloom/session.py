"""Session helpers: a local session for tests and the shared work folder."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster passes its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("barloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BARLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder the cluster names in spark.checkpoint.dir.

    Where that setting is absent, a session on one machine (local master: tests, a laptop) gets a temporary folder for
    its lifetime; any other master is refused, as its executors would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _one_machine_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@functools.cache
def _one_machine_folder() -> str:
    base = tempfile.mkdtemp(prefix="barloom-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the work folder and read it back.

    Cuts the lineage between stages that hand a small result to many consumers; the table is in
    shared storage, so a lost executor does not lose it.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
