"""Session and table helpers shared by every query, and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "plotwise", cpus: int | None = None) -> SparkSession:
    """A session with adaptive execution; in local mode as many shuffle partitions as cores."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.extraJavaOptions", "-Djava.net.preferIPv4Stack=true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; only Spark opens the path, so any store it can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reliable(spark: SparkSession) -> str:
    """Make checkpoint() usable and name its folder: the cluster's shared one, or in local mode, where none is named, one of our own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="plotwise-checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(frame: DataFrame, eager: bool = True) -> DataFrame:
    """The frame read back from a reliable checkpoint, which outlives lost executors."""
    reliable(frame.sparkSession)
    return frame.checkpoint(eager)
