"""Session construction and shipping of this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def get_session(app: str = "millrace", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators expect; an existing session is reused.

    The number of shuffle partitions is the cluster's own unless one is named; adaptive execution joins small ones.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (builder.master(master) if master else builder).getOrCreate()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per context, so that Python workers can import it anywhere.

    Python gets at most about 4 MB at once, where the session has Spark's default for that.
    """
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, "4m")
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return spark
    folder = tempfile.mkdtemp(prefix="millrace-")
    target = os.path.join(folder, "millrace.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, str(p.relative_to(_ROOT.parent)))
    sc.addPyFile(target)
    sc._millrace_shipped = True
    return spark
