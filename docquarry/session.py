"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and Spark runs on one machine, as in
    tests, a temporary folder is made and remembered for the session; on a cluster that is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy.

    What its making shuffled is not needed any more. Spark by itself removes such files only when the driver's objects for
    them are collected, which a driver with memory to spare puts off until the disks are full; here they go when the copy is
    written. ``free`` also asks the driver to collect its garbage now, for steps after which written copies are left over.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        written = df.select("*").checkpoint(eager=True)  # a plan keeps the setting under which it was made
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)
    del df
    if free:
        spark.sparkContext._jvm.System.gc()
    return written


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of an input folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with costly columns that are made once: the optimiser does not copy them into later filters and columns.

    A generator of one row holds each; it works row by row and keeps the pipeline of the stage.
    """
    for name, column in columns.items():
        df = df.select(*(c for c in df.columns if c != name), F.explode(F.array(F.struct(column.alias("v")))).alias("__s")).withColumn(name, F.col("__s.v")).drop("__s")
    return df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is read in fewer parts than there are cores, as from one small file; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
