"""Whole plans: from documents to chunks, reports and indexes; and helpers for building plans."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once, however often they are used.

    The optimizer merges projections, and repeats an expression at each use; it does not reach through a generator.
    """
    keep = [c for c in df.columns if c not in columns]
    all_ = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.select(*keep, F.explode(F.array(all_)).alias("__computed")).select(
        *keep, *[F.col(f"__computed.{k}").alias(k) for k in columns]
    )


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with each row's position from 0, in the order of its partitions.

    Rows are numbered within their partition, and the counts of the partitions before, a row for each, are added; so no
    task holds the table. ``df`` is what gives the same partitions each time: files, or a table that is kept.
    """
    at = F.monotonically_increasing_id()
    placed = df.withColumns({"__part": F.shiftright(at, 33).cast("int"), "__in": at.bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()  # a row for each partition
    before, rows = 0, []
    for r in counts:
        rows.append((r["__part"], before))
        before += r["n"]
    starts = df.sparkSession.createDataFrame(rows, "__part int, __before long")
    return placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col("__in")).select(*df.columns, name)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions than that; larger inputs are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def kept(df: DataFrame) -> DataFrame:
    """``df`` evaluated once for several uses, in the shared folder of checkpoints; it goes when ``df`` is no longer
    used, if the session cleans checkpoints. Only where executors are threads of this process, and no folder is named,
    it is kept on their disk. A cluster without a shared folder is refused, as it could not outlive a lost executor.
    """
    sc = df.sparkSession.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local"):
            return df.persist(StorageLevel.DISK_ONLY)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return df.checkpoint()
