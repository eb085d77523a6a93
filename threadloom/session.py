"""Session helpers: defaults, shipping the package to executors, reliable checkpoints."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def build_session(app: str = "threadloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the defaults this engine expects (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application.

    Executors that already have the package on their path are not harmed by it.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or spark.sparkContext.master.startswith("local["):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(), "threadloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for base, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder of ``spark.checkpoint.dir``; survives the loss of executors.

    The setting of the session is kept; only where it is unset (tests, a laptop) a local folder is set.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="threadloom-"))
    return df.checkpoint(eager=True)
