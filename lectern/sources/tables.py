"""Parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over the cluster when the files give fewer splits than there are cores.

    A corpus of many files already has a split per core and is left alone; a single small file would
    put all its text work in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
