"""What the operators need from the session: tables, cut lineage, and limits that hold at any size."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named a local one is made and removed at the end, on a local master only: on a
    cluster a folder of one machine would lose checkpoints, so that raises."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get(CHECKPOINT) or spark.conf.get(CHECKPOINT, None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"name a folder that all machines share in {CHECKPOINT}")
        named = tempfile.mkdtemp(prefix="shelfspark-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint: computed once, whatever reads them later or is lost. Spark removes the files of a
    checkpoint that nothing refers to any more if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def skew_aware(spark: SparkSession) -> None:
    """Adaptive execution with skew splitting; on by default, said here because hot keys rely on it."""
    for key in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.coalescePartitions.enabled"):
        spark.conf.set(key, "true")
