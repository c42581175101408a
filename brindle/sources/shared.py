"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which is set only where it is unset (local runs)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='brindle-')}"
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/brindle-{uuid.uuid4().hex}"


#: Has Spark remove what a query shuffled as soon as it ends, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df, written once and read back: what follows reads the written rows however often it uses them, and its size is known to the planner. What was shuffled to make it is removed."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.unset(CLEANUP) if old is None else spark.conf.set(CLEANUP, old)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes what stored() wrote for df; nothing may read it any more."""
    for f in df.inputFiles()[:1]:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f).getParent()
        if not folder.getName().startswith("brindle-"):
            raise ValueError(f"not a stored table: {f}")
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
