"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of this machine only where executors are threads of it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="millrace-shared-")
    sc.setCheckpointDir(folder)
    return folder


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Tables:
    """Parquet tables of one plan under one folder, which is removed when the driver exits if it is a temporary one."""

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None):
        self.spark = spark
        self.root = folder.rstrip("/") if folder else f"{shared_folder(spark)}/millrace-{name}-{uuid.uuid4().hex}"
        if folder is None:
            atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None, **options: object) -> DataFrame:
        """Write ``df`` in place of what ``name`` had, and return the written table."""
        df.write.mode("overwrite").options(**options).partitionBy(*(partition_by or [])).parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read if like is None else self.spark.read.schema(like.schema)
        return reader.parquet(self.path(name))

    def drop(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # the context is gone when the interpreter ends
            return
