"""Results that are computed once, in the folder that driver and executors share; rows that are dealt over the cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where the session names none and is local, as in tests, one of its own."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame) -> DataFrame:
    """The rows of df dealt over all cores, for rows that are small to move and slow to work on: a file of few megabytes is one task otherwise."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


#: Rows that one task sorts or groups, where the number of rows is known beforehand.
ROWS_A_TASK = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Over how many tasks so many rows are dealt by a key, so that the memory of one does not grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))
