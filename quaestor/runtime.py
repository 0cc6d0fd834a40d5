"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root``."""
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def scan_partitions(df: DataFrame) -> int:
    """Tasks of the first stage of ``df``; for bare scans, whose planning runs nothing."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def spread(df: DataFrame, *keys: str, rows_per_task: int | None = None) -> DataFrame:
    """Repartition by ``keys`` only where the scan has fewer tasks than the cluster has slots.

    Python-heavy stages over one small file would otherwise run in one task; a scan
    that is already wide is left alone, so large inputs pay no extra shuffle. With
    ``rows_per_task`` small inputs get no more tasks than that leaves them.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if scan_partitions(df) >= slots:
        return df
    tasks = 2 * slots if rows_per_task is None else min(2 * slots, max(1, df.count() // rows_per_task))
    return df.repartition(tasks, *[F.col(k) for k in keys])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one is made only for local masters."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="quaestor-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


def tables_dir(spark: SparkSession) -> str:
    """The folder of this application's written tables, inside the shared one."""
    return os.path.join(checkpoint_dir(spark), f"quaestor-tables-{spark.sparkContext.applicationId}")


def drop_written(spark: SparkSession) -> None:
    """Delete all tables this application has written; results that are still to be read must be saved before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, compressed and read back by column.

    Unlike a checkpoint its size is known to the planner; ``by`` names a column to split it by.
    """
    path = os.path.join(tables_dir(df.sparkSession), uuid.uuid4().hex)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so their Python can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_quaestor_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quaestor-package-")  # read by the driver only, which serves it to executors
    path = os.path.join(folder, "quaestor.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for base, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    archive.write(full, os.path.join("quaestor", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._quaestor_shipped = True
