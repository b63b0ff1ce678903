"""Session construction with the settings every plan here assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "chronolens", cores: int | None = None, partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks.

    A cluster session only needs UTC and ANSI mode (both Spark settings);
    everything else is left to spark-submit.
    """
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CHRONOLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; a temporary one only where the setting is absent."""
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chronolens-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a session, for clusters where it isn't installed."""
    import shutil
    import tempfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_chronolens_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="chronolens-ship-")
    context.addPyFile(shutil.make_archive(f"{folder}/chronolens", "zip", here.parent, here.name))
    context._chronolens_shipped = True
