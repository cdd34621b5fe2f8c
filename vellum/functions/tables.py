"""What tables need besides expressions: enough partitions for work on single rows, and lineage cut in shared folders."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """The folder in ``spark.checkpoint.dir``, which all machines share. Only a session on one machine may do without
    it, and gets a temporary folder; elsewhere a local folder would lose data with its executor, so this raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix=f"{name}-")


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder (``shared_folder``) and go on from there. The files live as long as
    what reads them; the session's cleaner removes them if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written, on whichever file system it lies."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as the session has cores, where its scan gives fewer, as for a file of one row
    group. A table of more partitions is left as it is, so nothing large is moved."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def totals(numbered: DataFrame, length: int) -> np.ndarray:
    """The sum of all partitions' vectors, which come as rows of k and value: partial sums where they arise, then one
    sum for each place, spread over the shuffle's partitions."""
    out = np.zeros(length)
    for r in numbered.groupBy("k").agg(F.sum("value").alias("value")).collect():  # a row for each parameter
        out[r["k"]] = r["value"]
    return out


PLACE_BITS = 33  # of a monotonically increasing id: the place in the partition


def in_ranges(df: DataFrame, *order: str | Column, part: str, at: str) -> DataFrame:
    """``df`` in ranges of ``order``, sorted, with the number of each row's range and its place there, from 0.

    It is written once and only read afterwards. A plan with a range partitioning gives other ranges each time it is
    evaluated (bounds come from a sample, adaptive execution joins small ranges), so counts, tables and results that were taken
    from several evaluations wouldn't belong together.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    own = F.col(at)
    return shared_checkpoint(placed).withColumns({part: F.shiftright(own, PLACE_BITS).cast("int"), at: own.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))})


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it none of the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
