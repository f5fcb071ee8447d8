"""Tables in the shared folder that cut lineage and survive lost executors.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset and the executors are
threads of this process, as in tests, is a temporary folder of this machine set instead.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.session import ship_package


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder that the driver and all executors share."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        elif not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            named = "file://" + tempfile.mkdtemp(prefix="millrace-shared-")
            sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Settings that the operators need, and Spark's defaults that they replace; a setting of the caller's own stays.
#: Python gets at most about 4 MB of texts at once. Files are cut into the same partitions however many executors there
#: are just now, so that numbers of rows, which follow the partitions, are the same in every scan.
SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"),
    "spark.sql.files.minPartitionNum": (None, None),
}


def prepared(spark: SparkSession) -> SparkSession:
    """Ship the package, and see to SETTINGS."""
    for key, (default, value) in SETTINGS.items():
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, value or str(spark.sparkContext.defaultParallelism))
    return ship_package(spark)


def release() -> None:
    """Give memory that a Python worker no longer uses back to the machine; idle workers are kept for later tasks."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


class Workspace:
    """A folder of intermediate Parquet tables of one operator call, removed when the driver exits."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = prepared(spark)
        self.root = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str = "table", instead_of: DataFrame | None = None) -> DataFrame:
        """Write ``df`` and return the written table; a table that it takes the place of is deleted."""
        path = self.path(name)
        df.write.parquet(path)
        if instead_of is not None:
            self.drop(instead_of._millrace_path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._millrace_path = path
        return out

    def settled(self, df: DataFrame, name: str = "input") -> DataFrame:
        """``df`` if it is files as they lie, whose rows come in the same partitions and order in every scan; else a
        table of its rows. Needed where rows are numbered and the numbers are used in several scans."""
        todo = [df._jdf.queryExecution().optimizedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName() not in ("Project", "Filter", "LogicalRelation") and not node.nodeName().startswith("Relation"):
                return self.table(df, name)
            children = node.children()
            todo += [children.apply(k) for k in range(children.size())]
        return df

    def drop(self, path: str | None = None) -> None:
        """Delete one table, or the whole folder."""
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path or self.root)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception as error:  # the context is gone when the interpreter ends
            if path:
                raise error
